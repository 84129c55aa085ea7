"""Near copies by the Jaccard similarity of their sets of word shingles.

Candidates come from SimHash first: the fingerprints of the same shingles, linked at 2 or fewer differing bits through the
covering masks of :mod:`simhash`.  No radius that can be enumerated reaches all pairs of similarity 0.8, so the rest
comes from MinHash bands: two sets of similarity s share one of the ``BANDS`` keys with probability
1 - (1 - s ** BAND_ROWS) ** BANDS, at s = 0.8 all but 8 in a million, and above it fewer still are missed.  Every pair
that shares a key is decided exactly, on the whole sets, unless it is connected already:

1. Equal sets are linked, and one of them stands for all.
2. Each row is held against the first row of its fingerprint, first rows against those of linked fingerprints, and each
   row against the first row of each of its buckets, ``BANDS`` rows at most.  Their links make components.
3. A bucket whose rows are not yet one component is cut into blocks of about ``BLOCK`` rows.  The largest component of a
   bucket has blocks of its own, which meet the blocks of the other rows but not each other; so a large group of
   copies costs rows in proportion to its size.  Each pair of blocks is decided in a task's unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import simhash
from lodestrand.llm.common import Scratch
from lodestrand.llm.graph import components
from lodestrand.llm.simhash import fingerprint
from lodestrand.llm.xxh import xxh64_ranges

WORDS = 5
FIFTHS = 4  # two sets are near from a similarity of 4/5
BANDS, BAND_ROWS = 64, 8
BLOCK = 128
CHUNK = 1 << 16
NARROW, WIDE = 256, 2048
SLICE = 64

_rng = np.random.default_rng(17)
FLIP = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)[:, None]
SPREAD = (_rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
FOLD = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashed shingles, sorted; texts without words share one set."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return np.zeros(1, np.uint64)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    k = min(WORDS, len(raw))
    starts = begin[: len(raw) - k + 1]
    lengths = begin[k - 1 :] + size[k - 1 :] - starts
    data = b" ".join(raw)
    return np.unique(np.concatenate([xxh64_ranges(data, starts[i : i + CHUNK], lengths[i : i + CHUNK]) for i in range(0, len(starts), CHUNK)]))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band; a band's number is part of its key."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(FLIP), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), NARROW):
        low = np.minimum(low, ((x[i : i + NARROW] ^ FLIP) * SPREAD).min(axis=1))
    keys = ((low.reshape(BANDS, BAND_ROWS).astype(np.uint64) + np.uint64(1)) * FOLD).sum(axis=1, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * FOLD[:, 0]).view(np.int64)


def near_pairs(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between near sets, enough to connect all that are; memory in proportion to the sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = (counts > 1)[inverse]
    at, owner = column[inverse][shared], np.repeat(np.arange(n), sizes)[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((n, n), np.float64)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, WIDE):
        a, b = np.searchsorted(at, [first, first + WIDE])
        m = np.zeros((n, WIDE), np.float32)
        m[owner[a:b], at[a:b] - first] = 1
        common += m @ m.T
    near = 5 * common >= FIFTHS * (sizes[:, None] + sizes[None, :] - common)
    root, out = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between rows of near texts, enough to connect all that are: rows has row_id and text."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "near")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, keys, fps = [], np.empty((b.num_rows, BANDS), np.int64), np.empty(b.num_rows, np.uint64)
            for i, t in enumerate(b.column("text")):
                s = shingles(t.as_py())
                fps[i] = fingerprint(t.as_py(), WORDS)
                same.append(xxhash.xxh128_digest(s.tobytes()))
                keys[i] = band_keys(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(same, pa.binary()), lists, pa.array(fps.view(np.int64))], ["row_id", "same", "keys", "fp"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, SLICE):  # few rows at a time: sets of long texts are large
                part = b.slice(first, SLICE)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column("text")]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("row_id"), lists], ["row_id", "shingles"])

    def decide(unit: pa.Table) -> pa.Table:
        lists = unit["shingles"].combine_chunks()
        flat, stops = lists.flatten().to_numpy().view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
        found = near_pairs(unit["row_id"].to_numpy(), [flat[i:j] for i, j in zip(stops, stops[1:])])
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    signed = scratch.write(rows.mapInArrow(sign, "row_id bigint, same binary, keys array<bigint>, fp bigint"), "signed")
    first = scratch.write(signed.groupBy("same").agg(F.min("row_id").alias("b"), F.max("row_id").alias("last")), "first")
    several = first.where("b <> last")
    equal = signed.select("row_id", "same").join(several, "same").where("row_id <> b").select(F.col("row_id").alias("a"), "b")

    ones = signed.join(first.select(F.col("b").alias("row_id")), "row_id", "left_semi")
    prints = scratch.write(ones.groupBy("fp").agg(F.min("row_id").alias("pivot"), F.max("row_id").alias("last")), "prints")
    alike = ones.select("row_id", "fp").join(prints.where("pivot <> last"), "fp").where("row_id <> pivot").select("row_id", "pivot")
    leads = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("pivot").alias(name))
    apart = simhash.links(prints.select("fp")).join(leads("a", "x"), "a").join(leads("b", "y"), "b")
    close = scratch.write(alike.unionByName(apart.select(F.greatest("x", "y").alias("row_id"), F.least("x", "y").alias("pivot"))), "close")

    keyed = ones.select("row_id", F.explode("keys").alias("key"))
    # min and count are combined before the shuffle, so a hot key costs one row a task
    shared = keyed.groupBy("key").agg(F.min("row_id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(keyed.join(shared, "key"), "members")
    pairs = members.where("row_id <> pivot").select("row_id", "pivot").unionByName(close).distinct()
    held = members.select("row_id").unionByName(close.select(F.explode(F.array("row_id", "pivot")).alias("row_id"))).distinct()
    sets = scratch.write(rows.join(held, "row_id", "left_semi").select("row_id", "text").mapInArrow(cut, "row_id bigint, shingles array<bigint>"), "sets")

    both = pairs.join(sets, "row_id").join(sets.select(F.col("row_id").alias("pivot"), F.col("shingles").alias("others")), "pivot")
    common = both.select("row_id", "pivot", (F.size("shingles") + F.size("others")).alias("sizes"), F.size(F.array_intersect("shingles", "others")).alias("common"))
    near = common.where((FIFTHS + 5) * F.col("common") >= FIFTHS * F.col("sizes"))  # 5 common >= 4 (sizes - common)
    direct = scratch.write(near.select(F.col("row_id").alias("a"), F.col("pivot").alias("b")), "direct")

    roots = components(direct, Scratch(spark, "near-groups")).select(F.col("node").alias("row_id"), "root")
    named = members.where("n > 2").join(roots, "row_id", "left").select("key", "row_id", F.coalesce("root", "row_id").alias("root"))
    named = scratch.write(named, "named")
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "root"))
    buckets = sizes.groupBy("key").agg(largest.alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    buckets = buckets.select("key", F.col("top.root").alias("big"), blocks(F.col("top.n")).alias("p"), blocks(F.col("all") - F.col("top.n")).alias("q"))
    dealt = named.join(buckets, "key").withColumn("pure", F.col("root") == F.col("big"))
    block = F.pmod(F.xxhash64("row_id"), F.when(F.col("pure"), F.col("p")).otherwise(F.col("q"))).cast("int")
    dealt = dealt.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    across = F.transform(upto(F.col("q")), lambda j: unit(0, F.col("block"), j))
    inside = F.transform(F.when(F.col("q") == 1, F.array(F.lit(0))).otherwise(F.array_remove(upto(F.col("q")), F.col("block"))), lambda j: unit(1, F.least("block", j), F.greatest("block", j)))
    others = F.concat(F.transform(upto(F.col("p")), lambda i: unit(0, i, F.col("block"))), inside)
    dealt = dealt.select("row_id", "key", F.explode(F.when(F.col("pure"), across).otherwise(others)).alias("unit"))
    units = dealt.join(sets, "row_id").select("row_id", "shingles", "key", "unit.kind", "unit.low", "unit.high")
    rest = units.groupBy("key", "kind", "low", "high").applyInArrow(decide, "a bigint, b bigint")
    return direct.unionByName(equal).unionByName(rest)


def near_dedup(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_id and component_key; rows whose 5-word shingles have a Jaccard similarity of
    0.8 or more share a component, and so do those that such pairs connect.

    ``row_col`` tells rows apart and is not null; ids may be null or repeat.  Words are folded (ASCII); shorter texts
    are one shingle, and null and empty texts and those of white space alone equal each other.  No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(row_col).alias("row_id"), F.col(text_col).alias("text"))
    roots = components(links(rows.select("row_id", "text")), Scratch(docs.sparkSession, "near-roots")).select(F.col("node").alias("row_id"), "root")
    return rows.select("doc_id", "row_id").join(roots, "row_id", "left").select("doc_id", "row_id", F.coalesce("root", "row_id").alias("component_key"))
