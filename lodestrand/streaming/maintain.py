"""File changes as a stream: pairing of moves, the last change of each path, and upkeep of a stored graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrand.operators.resolve import resolved_edges
from lodestrand.operators.store import GraphStore, added_counters
from lodestrand.plans.virtual import Graph

KINDS = ("created", "modified", "deleted", "renamed")
CHANGES = "seq bigint, ts timestamp, kind string, path string, old_path string"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder of JSON files, each line a change."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def last_changes(changes: DataFrame) -> DataFrame:
    """path, gone, seq: what each path came to.  A rename is the end of its old path, then a change of the new one."""
    parts = F.array(
        F.struct(F.col("path").alias("path"), (F.col("kind") == "deleted").alias("gone"), F.lit(1).alias("part")),
        F.struct(F.col("old_path").alias("path"), F.lit(True).alias("gone"), F.lit(0).alias("part")),
    )
    steps = changes.select("seq", F.explode(parts).alias("s")).where(F.col("s.path").isNotNull())
    return steps.groupBy(F.col("s.path").alias("path")).agg(F.max_by("s.gone", F.struct("seq", "s.part")).alias("gone"), F.max("seq").alias("seq"))


def paired_moves(moves: DataFrame) -> DataFrame:
    """seq, kind, path, old_path from the two halves of moves (seq, cookie, side, path).

    A second half after a first one with its cookie is a rename; alone it is a creation; a first half alone is lost.
    """
    first = moves.where("side = 'from'").select("cookie", F.col("path").alias("old_path"), F.col("seq").alias("from_seq"))
    whole = moves.where("side = 'to'").join(first, "cookie", "left")
    ok = F.col("from_seq") < F.col("seq")
    return whole.select("seq", F.when(ok, "renamed").otherwise("created").alias("kind"), "path", F.when(ok, F.col("old_path")).alias("old_path"))


Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


class Maintainer:
    """Keeps a stored graph current: each batch is one new generation.

    ``extract`` gives symbols, unresolved edges and file rows of the given paths.  Unresolved edges are stored, and edges
    are resolved anew from all of them, so what other files refer to is found again after a file changes.  A batch that
    is repeated after a failure comes to the same tables.
    """

    def __init__(self, store: GraphStore, extract: Extract):
        self.store, self.extract = store, extract

    def apply(self, changes: DataFrame, batch: int = -1) -> int | None:
        """The number of the new generation; None if there was nothing to do."""
        if batch >= 0 and int(self.store.meta().get("batch", -1)) >= batch:
            return None
        last = last_changes(changes).persist()
        if last.isEmpty():
            return None
        graph = self.store.load()
        symbols, pending, files = self.extract(last.where("not gone").select("path"))
        if graph is not None:
            touched = last.select("path")
            keep = lambda rows, column: rows.join(touched.withColumnRenamed("path", column), column, "left_anti").select(*rows.columns)
            symbols = keep(graph.symbols, "file").unionByName(symbols)
            pending = keep(graph.pending, "caller_file").unionByName(pending)
            files = keep(graph.files, "path").unionByName(files)
        number = self.store.save(Graph(symbols, resolved_edges(pending, symbols), pending, files), batch=str(batch))
        last.unpersist()
        return number

    def start(self, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Runs ``apply`` on each micro-batch; with ``once`` it stops when the folder is read up."""
        writer = changes.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def change_counts(changes: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Changes of each kind by window of event time; a stream or a table."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return rows.groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))


def running_counters(old: DataFrame, batch: DataFrame) -> DataFrame:
    return added_counters(old, batch)
