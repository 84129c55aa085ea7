"""SimHash near-dedup: covering locality-sensitive hashing over 64-bit fingerprints.

Every bit position gets a vector of ``radius + 1`` bits, not zero.  For each non-zero vector v there is a table that
keeps the positions whose vector has an odd inner product with v.  Any ``radius`` positions span at most ``radius``
dimensions, so some v is orthogonal to all of theirs: in that table a pair that differs there and nowhere else has
equal keys.  No pair within the radius is missed, by construction.

Buckets are never expanded into pairs.  Members of a shared bucket can differ in its dropped positions only, so each
emits itself and its neighbours at one flipped dropped position.  Two fingerprints are within 2 bits exactly if they
share such a point, and at most 65 distinct fingerprints share one: a bound that holds for any data.  Each point links
its members to its smallest one, and the links go through distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch, id_order
from lodestrand.llm.graph import components
from lodestrand.llm.xxh import xxh64_ranges

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included; unsigned.  No words: zero."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    k = min(words, len(raw))
    starts = begin[: len(raw) - k + 1]
    lengths = begin[k - 1 :] + size[k - 1 :] - starts
    data = b" ".join(raw)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):  # bounded memory for any length of text
        h = xxh64_ranges(data, starts[i : i + CHUNK], lengths[i : i + CHUNK], seed)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_id and fp, the fingerprint's 64 bits as a signed long."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_id"), pa.array(fp)], ["doc_id", "row_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), row.alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_id bigint, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The positions that each table keeps, as signed longs."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within 2 bits, enough to connect all that are: fps has fp, distinct."""
    masks = covering_masks()
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("tab", "key"))
    # min and max are combined before the shuffle, so a hot bucket costs one row a task
    shared = keyed.groupBy("tab", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("tab", "key")
    dropped = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("tab") + 1)
    members = keyed.join(shared, ["tab", "key"]).groupBy("fp").agg(F.bit_or(dropped).alias("open"))
    flips = F.filter(F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(BITS)]), lambda bit: bit.bitwiseAND(F.col("open")) == bit)
    points = members.select("fp", F.explode(F.transform(flips, lambda bit: bit.bitwiseXOR(F.col("fp")))).alias("point"))
    # at most 65 distinct fingerprints lie within one bit of a point
    near = points.groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return near.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a <> b").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, then component_key and row_id.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id reachable, the row's own
    included.  Null and empty texts, and those of white space alone, have fingerprint zero and link like any other.
    Null ids never are the smallest; a component of null ids only has a null component_id.  Repeated ids and rows each
    give a row.  No rows give no rows.  Further columns are ignored.  Texts are hashed whole, in chunks.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, row_col, words), "fingerprints")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp")), scratch).select(F.col("node").alias("fp"), "root")
    grouped = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("component_key"))
    lowest = grouped.groupBy("component_key").agg(F.min("low").alias("component_id"))
    named = grouped.select("fp", "component_key").join(lowest, "component_key")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_key", "row_id")


def survivors(decisions: DataFrame) -> DataFrame:
    """row_id of the row that stays in each component: the smallest doc_id, and of repeated ids the first row."""
    return decisions.groupBy("component_key").agg(F.min(id_order("doc_id", "row_id")).alias("first")).select(F.col("first.row").alias("row_id"))
