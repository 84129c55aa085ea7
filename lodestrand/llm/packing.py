"""Best-fit packing of token sequences, bulk-synchronous.

Pieces and gaps are kept in order of size, as runs: sizes are whole numbers of at most the capacity, so all pieces of
one size are alike and so are all sequences with one gap.  A round takes the next size, from the largest down, sweeps
the gaps upwards from the first that is large enough (its successor), and matches run with run; which piece goes to
which sequence is decided by rank inside the runs; the gaps are updated and the next round begins.  The runs number at
most a few times the capacity whatever the input, so rounds cost nothing; all work on pieces is distributed: token
ids, local ranks inside each shard, prefix sums of shard counts, and the placing of each piece by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.bpe import UnitEncoder
from lodestrand.llm.common import Scratch

CAPACITY = 1024
END_ID = 2
NUMBERS = ("piece", "start", "length", "ids_crc32")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first may be shorter, the others are full."""
    first = n if n <= capacity else n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, n - s) if s or not first else first) for s in starts]


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, sequence of that rank, offset in it, pieces per sequence), by size and rank.

    Best-fit decreasing on runs: of the gaps that hold a piece, the smallest takes it, and goes on taking pieces of
    that size while it can.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, rows = 0, []
    for size in sorted((s for s, n in counts.items() if s and n), reverse=True):
        left, rank = counts[size], 0
        for gap in sorted(g for g in gaps if g >= size):
            runs, fits = gaps.pop(gap), gap // size
            while runs and left:
                first, n = runs.pop()
                rows.append((size, rank, first, capacity - gap, fits))
                full, rest = min(n, left // fits), 0
                if full < n:
                    rest = left - full * fits
                if full:
                    gaps.setdefault(gap - fits * size, []).append((first, full))
                if rest:
                    gaps.setdefault(gap - rest * size, []).append((first + full, 1))
                if n - full - bool(rest):
                    runs.append((first + full + bool(rest), n - full - bool(rest)))
                left, rank = left - full * fits - rest, rank + full * fits + rest
            if runs:
                gaps.setdefault(gap, []).extend(runs)
            if not left:
                break
        if left:
            fits = capacity // size
            full, rest = divmod(left, fits)
            rows.append((size, rank, opened, 0, fits))
            if full:
                gaps.setdefault(capacity - fits * size, []).append((opened, full))
            if rest:
                gaps.setdefault(capacity - rest * size, []).append((opened + full, 1))
            opened += full + bool(rest)
        gaps.pop(0, None)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, ranks_path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """A row per piece, with its shard (task) and its rank among the shard's pieces of that length."""
    sc = docs.sparkSession.sparkContext
    files = sc.broadcast((Path(ranks_path).read_bytes(), Path(tokenizer_path).read_text(encoding="utf-8")))  # fixed files of a few MB
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, shard = UnitEncoder(*files.value), {}, TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text")):
                ids = encoder.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rank = seen[length] = seen.get(length, -1) + 1
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), shard, rank))
            at, *rest = np.array(rows, np.int64).reshape(-1, 7).T
            columns = [pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *columns], ["doc_id", *NUMBERS, "shard", "rank"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, rank bigint")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    ranks_path: str | None = None,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone.  Ids may be null or repeat: each row is a document of its own.  Texts
    are encoded whole, however long.  No rows give no rows.  Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    parts = scratch.write(pieces(docs, id_col, text_col, capacity, ranks_path, tokenizer_path, end_id), "pieces")

    shards = parts.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = scratch.write(shards.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "shards")
    counts = {r["length"]: r["n"] for r in shards.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = best_fit_runs(counts, capacity)
    plan = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, seq, offset, fits = plan.value.T
        # runs of a size are in order of rank: one number orders both
        stride = int(first.max(initial=0)) + 2
        order = size * stride + first
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(order, length * stride + np.minimum(rank, stride - 1), side="right") - 1
            k = rank - first[at]
            placed = [pa.array(seq[at] + k // fits[at]), pa.array(offset[at] + k % fits[at] * length)]
            kept = ["doc_id", *NUMBERS]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *placed], [*kept, "sequence_id", "offset"])

    ranked = parts.join(shards.select("length", "shard", "before"), ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    kind = dict(parts.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
