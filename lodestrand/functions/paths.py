"""Paths, languages and URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import constants as K

VENDOR = "/(" + "|".join(K.VENDOR_DIRS) + ")/"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What is before the last slash; empty without one.  It is also the module of a file."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def display(path: Column, root: Column) -> Column:
    """Relative to the root at a boundary; the root itself is a dot."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(root == "", path).when(path == root, ".").when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def resolved(path: Column, root: Column) -> Column:
    return F.when(path.startswith("/") | (root == ""), path).otherwise(F.concat(root, F.lit("/"), path))


def is_vendor(path: Column) -> Column:
    return path.rlike(VENDOR)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^.]*)$", 1)


def language(path: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in K.EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, extension(path)), F.lit(K.UNKNOWN_LANG))


def in_skipped_dir(directory: Column) -> Column:
    """Any part of the path is hidden or one of the skipped names."""
    return F.exists(F.split(directory, "/"), lambda d: (d.startswith(".") & (d != "")) | d.isin(*K.SKIPPED_DIRS))


def url_parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null if it is not there."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
    return F.when(query.rlike(f"(?:^|&){name}="), F.try_url_decode(raw))


def size_label(size: Column) -> Column:
    return (
        F.when(size >= 1024 * 1024, F.format_string("%.1fM", size / (1024.0 * 1024.0)))
        .when(size >= 1024, F.format_string("%.1fK", size / 1024.0))
        .otherwise(F.concat(size.cast("string"), F.lit("B")))
    )
