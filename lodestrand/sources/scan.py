"""Source trees: which files there are, what language they are in, and reading them on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lodestrand.functions import constants as K

SCANNED = "path string, mtime bigint, size bigint, lang int"


def skipped_dir(name: str) -> bool:
    return name.startswith(".") or name in K.SKIPPED_DIRS


def language_of(path: str) -> int:
    name = path.rsplit("/", 1)[-1]
    return K.EXTENSIONS.get(name.rsplit(".", 1)[-1], K.UNKNOWN_LANG) if "." in name else K.UNKNOWN_LANG


def walk(root: str) -> Iterator[tuple[str, int, int, int]]:
    """(path, mtime, size, lang) of regular files of a known language, not empty and not too large."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not skipped_dir(d))
        for name in sorted(names):
            path = os.path.join(folder, name)
            lang = language_of(path)
            if lang == K.UNKNOWN_LANG or os.path.islink(path) or not os.path.isfile(path):
                continue
            stat = os.stat(path)
            if 0 < stat.st_size <= K.MOST_FILE_BYTES:
                yield path, int(stat.st_mtime), stat.st_size, lang


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """The files of a tree, listed on the driver: Spark's own listing would leave out names that begin with _ or a dot."""
    return spark.createDataFrame(list(walk(root)), SCANNED)


def read_source(path: str) -> bytes | None:
    """The bytes of a file; None if it is empty, too large, binary, or gone."""
    try:
        if not 0 < os.path.getsize(path) <= K.MOST_FILE_BYTES:
            return None
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    return None if b"\0" in data[:512] else data
