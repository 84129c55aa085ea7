"""Changes to stored tables as DataFrames, and generations of a graph on disk."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.plans.virtual import Graph

SYMBOLS = "id bigint, name string, file string, line int, col int, end_line int, kind int, signature string, scope string, lang int, is_definition boolean, seq bigint"
EDGES = "from_id bigint, to_id bigint, kind int, seq bigint"
PENDING = "caller_file string, caller_name string, callee_name string, caller_line int, kind int, seq bigint"
FILES = "path string, mtime bigint, size bigint, hash string, lang int, error_count int"
META, STATS = "key string, value string", "key string, value bigint"


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key, at the place of its first: the newest columns with the smallest ``order``."""
    rest = [c for c in old.columns if c not in (key, order)]
    every = old.select(key, order, *rest).unionByName(new.select(key, order, *rest))
    last = F.max_by(F.struct(*rest), order)
    return every.groupBy(key).agg(last.alias("last"), F.min(order).alias(order)).select(key, "last.*", order).select(*old.columns)


def added_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both, each once and at its first place."""
    return old.unionByName(new).groupBy("from_id", "to_id", "kind").agg(F.min("seq").alias("seq"))


def without_files(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols without those of the files (path), and edges without those that touch one."""
    gone = paths.select(F.col("path").alias("file")).distinct()
    ids = symbols.join(gone, "file", "left_semi").select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return symbols.join(gone, "file", "left_anti").select(*symbols.columns), kept.select(*edges.columns)


def stale_files(scanned: DataFrame, stored: DataFrame, forced: bool = False) -> DataFrame:
    """Scanned files that are new or changed, or all."""
    old = stored.select("path", F.col("mtime").alias("old_mtime"))
    return scanned.join(old, "path", "left").where(F.lit(forced) | F.col("old_mtime").isNull() | (F.col("old_mtime") != F.col("mtime"))).drop("old_mtime")


def deleted_files(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(scanned.select("path"), "path", "left_anti")


def merged_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same path."""
    return old.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)


def added_counters(*counters: DataFrame) -> DataFrame:
    """key and the sum of its values."""
    every = counters[0]
    for c in counters[1:]:
        every = every.unionByName(c)
    return every.groupBy("key").agg(F.sum("value").alias("value"))


def index_counters(files: DataFrame, symbols: DataFrame, edges: DataFrame, errors: int, millis: int) -> DataFrame:
    """key, value of one index run."""
    one = files.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("key"), "n")
    rows = one.unionByName(symbols.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols_found").alias("key"), "n"))
    rows = rows.unionByName(edges.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges_found").alias("key"), "n"))
    extra = files.sparkSession.createDataFrame([("errors", errors), ("index_ms", millis), ("index_runs", 1)], "key string, n bigint")
    return rows.unionByName(extra).select("key", F.col("n").alias("value"))


class GraphStore:
    """Generations of a graph: each is written whole to a folder of its own, and one small file for each says that it is
    finished; the last finished one is current.

    A reader of the current generation is not disturbed by a writer of the next one, and a writer that dies at any point
    leaves the current one in place, as no file is ever replaced.  Another schema or semantic version reads as no graph at all, so it is built anew.
    """

    TABLES = {"symbols": SYMBOLS, "edges": EDGES, "pending": PENDING, "files": FILES}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """Numbers of the generations that were finished, in order; the last one is current."""
        folder, fs = self._fs(f"{self.root}/current")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"meta-(\d+)\.json", n)))

    def _write(self, path: str, text: str) -> None:
        new, fs = self._fs(path)
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, number: int, text: str) -> None:
        """A pointer appears under its own name in one step, beside the one before it, which stays."""
        at = f"{self.root}/current/meta-{number}.json"
        self._write(f"{at}.new", text)
        new, fs = self._fs(f"{at}.new")
        if not fs.rename(new, self._fs(at)[0]):
            raise OSError(f"{at} could not be written; another writer may have been faster")

    def meta(self) -> dict[str, str]:
        numbers = self._pointers()
        if not numbers:
            return {}
        found = self.spark.read.text(f"{self.root}/current/meta-{numbers[-1]}.json", wholetext=True).first()
        return json.loads(found[0]) if found else {}

    def generation(self) -> int:
        return int(self.meta().get("generation", 0))

    def load(self) -> Graph | None:
        meta = self.meta()
        if meta.get("schema_version") != K.SCHEMA_VERSION or meta.get("semantic_version") != K.SEMANTIC_VERSION:
            return None
        at = f"{self.root}/generation-{meta['generation']}"
        symbols, edges, pending, files = (self.spark.read.schema(kind).parquet(f"{at}/{name}") for name, kind in self.TABLES.items())
        return Graph(symbols, edges, pending, files)

    def stats(self) -> DataFrame:
        """key, value: the counters of all runs so far."""
        at = f"{self.root}/generation-{self.generation()}/stats"
        path, fs = self._fs(at)
        return self.spark.read.schema(STATS).parquet(at) if fs.exists(path) else self.spark.createDataFrame([], STATS)

    def stat(self, key: str) -> int | None:
        found = self.stats().where(F.col("key") == key).first()
        return found["value"] if found else None

    def save(self, graph: Graph, counted: Callable[[DataFrame], DataFrame] | None = None, **meta: str) -> int:
        """Writes the next generation and makes it the current one.  The one before the current is removed.  ``counted``
        gives the counters (key, value) of this run from its written edges; they are added to those so far."""
        old = self.meta()
        number = int(old.get("generation", 0)) + 1
        at = f"{self.root}/generation-{number}"
        graph.symbols.repartition("file").sortWithinPartitions("file", "seq").write.mode("overwrite").parquet(f"{at}/symbols")
        graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
        graph.pending.write.mode("overwrite").parquet(f"{at}/pending")
        graph.files.write.mode("overwrite").parquet(f"{at}/files")
        run = [counted(self.spark.read.schema(EDGES).parquet(f"{at}/edges"))] if counted else []
        added_counters(self.stats(), *run).write.mode("overwrite").parquet(f"{at}/stats")
        text = json.dumps(old | meta | {"generation": str(number), "schema_version": K.SCHEMA_VERSION, "semantic_version": K.SEMANTIC_VERSION})
        self._publish(number, text)
        for n in self._pointers():
            if n < number - 1:
                path, fs = self._fs(f"{self.root}/generation-{n}")
                fs.delete(path, True)
                path, fs = self._fs(f"{self.root}/current/meta-{n}.json")
                fs.delete(path, False)
        return number
