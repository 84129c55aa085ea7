"""Exact dedup by an extendible-hash index on shared files, with DataFrame functions only.

The index has one entry for each distinct hash key.  A directory over the leading bits of the key starts with one
bucket and doubles while any bucket holds more than its capacity of entries; a bucket that is not overfull keeps its
shallower depth and is shared by several directory slots.  Keys are evenly spread, so the directory has about as many
slots as the index has capacities: it grows with the input, by some 12 bytes for 50,000 distinct texts.  Owner tasks each
take a range of buckets and keys, and write their part of the index, sorted by key, to the shared folder.  Rows are
looked up through the directory: slot, bucket, and the key inside the bucket.

Two texts with one key form a chain: the texts themselves are compared, byte by byte, by grouping on them.  Copies
are combined within each task before anything is shuffled, so that a hot text moves once a task.  Only keys whose
chain holds more than one text are told apart by the digest too, after it has been found to be one for one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch, id_order, normal_space

#: Keys have no more bits to split by.
MAX_DEPTH = 62
#: Levels beyond those that evenly spread keys need; keys that agree in more bits stay in one bucket, however many.
SPARE = 8
#: Levels that one count of the entries looks ahead.
AHEAD = 4
BUCKET_ENTRIES = 50_000


def hash_key(text: Column) -> Column:
    return F.xxhash64(text)


def slot_of(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(entries: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets as (depth, prefix, entries), by doubling: deeper levels are counted only for what is overfull.  What comes
    to the driver is a count for each slot of the level looked at, some ``2 ** AHEAD`` for each bucket at most."""
    total = entries.count()
    max_depth = min(max_depth, int(total / capacity).bit_length() + SPARE)
    buckets, overfull, depth = [], {0: total}, 0
    if total <= capacity:
        return [(0, 0, total)]
    while overfull and depth < max_depth:
        need = max(overfull.values()) / capacity
        level = min(max_depth, depth + max(1, int(need).bit_length() - 1) + AHEAD)
        inside = entries
        if depth:
            held = entries.sparkSession.createDataFrame([(p,) for p in overfull], "slot bigint")
            inside = entries.withColumn("slot", slot_of(depth)).join(F.broadcast(held), "slot", "left_semi")
        counts = {r["slot"]: r["n"] for r in inside.groupBy(slot_of(level).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
        while overfull and depth < level:
            depth += 1
            halves = {2 * p + b: 0 for p in overfull for b in (0, 1)}
            for s, n in counts.items():
                p = s >> (level - depth)
                if p in halves:
                    halves[p] += n
            overfull = {p: n for p, n in halves.items() if n > capacity and depth < max_depth}
            buckets += [(depth, p, n) for p, n in halves.items() if p not in overfull]
    return sorted(buckets, key=lambda b: b[1] << (MAX_DEPTH - b[0]))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    key: Callable[[Column], Column] = hash_key,
    capacity: int = BUCKET_ENTRIES,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, then row_id.

    Texts are equal when identical after replacing each run of ASCII white space by one space.  Of equal texts the row
    with the smallest id stays; null ids sort last, and of rows that also share the id the first one stays.

    A null text counts as empty; an empty text is a text like any other.  Long texts are compared whole.  No rows give
    no rows.  Further columns of ``docs`` are ignored whatever their names.  ``row_col`` names a unique long; without
    it rows are numbered as they are read, which is stable for tables read from files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).alias("doc_id"), normal_space(F.col(text_col)).alias("body"), row.alias("row_id"))

    records = scratch.write(
        texts.select("doc_id", "row_id", key(F.col("body")).alias("key"), F.unhex(F.sha2("body", 256)).alias("digest")),
        "records",
    )
    entries = records.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(id_order("doc_id", "row_id")).alias("first"))
    entries = scratch.write(entries, "entries")

    buckets = directory(entries, capacity, max_depth)
    depth = max(d for d, _, _ in buckets)
    slots = spark.createDataFrame([(s, i) for i, (d, p, _) in enumerate(buckets) for s in range(p << (depth - d), (p + 1) << (depth - d))], "slot bigint, bucket int")

    def owned(rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that owns their key."""
        return rows.withColumn("slot", slot_of(depth)).join(F.broadcast(slots), "slot").drop("slot")

    # Chains: the distinct texts of each key, compared as texts.  Copies are combined before the shuffle.
    compared = texts.select(key(F.col("body")).alias("key"), "body").groupBy("key", "body").agg(F.count(F.lit(1)).alias("copies"))
    chains = compared.groupBy("key").agg(F.count(F.lit(1)).alias("chain"))
    index = owned(entries).join(chains, "key").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    index = scratch.write(index, "index")

    rows = owned(records)
    found = rows.join(index.where("chain = 1").select("bucket", "key", "first", "n"), ["bucket", "key"])
    if not index.where("chain > 1").isEmpty():
        hot = index.where("chain > 1").select("bucket", "key")
        digests = compared.join(hot, "key").groupBy("key", F.unhex(F.sha2("body", 256)).alias("digest")).agg(F.count(F.lit(1)).alias("texts"))
        if not digests.where("texts > 1").isEmpty():
            raise ValueError("two texts have one digest")
        chained = rows.join(hot, ["bucket", "key"], "left_semi")
        groups = chained.groupBy("bucket", "key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(id_order("doc_id", "row_id")).alias("first"))
        found = found.unionByName(chained.join(groups, ["bucket", "key", "digest"]))
    return found.select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first.row") == F.col("row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )
