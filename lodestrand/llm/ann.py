"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more component, which makes their lengths equal, so that the largest inner product is the smallest
distance.  Each table hashes a vector by a few p-stable projections, floor((a . x + b) / w), end slots open; a slot
vector is a bucket.  A query orders the buckets of each table by the estimated probability that a near neighbour lies
there, and visits them in this order until the probabilities add up to the share that the fit asks for, and the
visited buckets hold enough rows.  Candidates of all tables are merged and ranked by their exact inner products.

The fit (length bound aside) uses a bounded sample: ``SAMPLE`` rows, those with the smallest hashes of their ids.
Every row is indexed.  Buckets are laid out in blocks of at most ``BLOCK`` rows; a larger bucket is split by the hash
of the id.  A block and the queries that visit it, ``QUERY_GROUP`` or fewer on average, meet in one task, where each visited
bucket is multiplied with the queries that visit it and with no other; at most ``k`` rows a query come back: pairs are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch

K = 20
TABLES = 2
SLOTS = 4
MOST_PROJECTIONS = 7
SAMPLE = 4096
SAMPLE_QUERIES = 256
BLOCK = 32_768
#: Queries of one group, on average; their vectors and a block's are what a task holds.
QUERY_GROUP = 16_384
RECALL = 0.96
SHARES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.999)

_cdf = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))), otypes=[float])


class Tables:
    """Projections and slots of all tables, fitted on a sample; small, and the same on every executor."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, k: int = K, seed: int = 7):
        self.longest, self.dims = longest, sample.shape[1]
        each = max(1, min(MOST_PROJECTIONS, self.dims, round(np.log(max(rows, 1) / 50) / np.log(SLOTS)) if rows > 50 else 1))
        rng = np.random.default_rng(seed)
        self.cells = SLOTS**each
        # Gaussian directions are 2-stable; those of one table are made orthogonal, which keeps each one's law
        self.planes = [np.linalg.qr(rng.standard_normal((self.dims + 1, each)))[0] * np.sqrt(self.dims + 1) for _ in range(TABLES)]
        x = self.lengthened(sample)
        at = [x @ a for a in self.planes]
        self.mean = [p.mean(axis=0) for p in at]
        self.width = [np.maximum(p.std(axis=0), 1e-12) for p in at]
        self.shift = [self.width[t] * (SLOTS // 2) - self.mean[t] for t in range(TABLES)]
        self.cosine, self.share = 0.5, 1.0
        self._fit(sample, x, k)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def hashed(self, x: np.ndarray) -> list[np.ndarray]:
        """The bucket of each row in each table."""
        long = self.lengthened(x)
        out = []
        for a, b, w in zip(self.planes, self.shift, self.width):
            slot = np.clip(np.floor((long @ a + b) / w), 0, SLOTS - 1).astype(np.int64)
            out.append(slot @ SLOTS ** np.arange(slot.shape[1]))
        return out

    def success(self, q: np.ndarray) -> list[np.ndarray]:
        """(queries, buckets) of each table: estimated probability that a near neighbour lies in the bucket."""
        q = np.column_stack([q * (self.longest / np.maximum(np.linalg.norm(q, axis=1), 1e-300))[:, None], np.zeros(len(q))])
        out = []
        for a, m, w in zip(self.planes, self.mean, self.width):
            centre = m + self.cosine * (q @ a - m)
            spread = w * sqrt(max(1 - self.cosine**2, 1e-4))
            edges = m + w * np.arange(1 - SLOTS // 2, SLOTS - SLOTS // 2)[:, None]
            below = _cdf((edges[:, None, :] - centre[None]) / spread)
            slots = np.diff(np.concatenate([np.zeros_like(below[:1]), below, np.ones_like(below[:1])]), axis=0)
            p = np.ones((len(q), 1))
            for j in range(a.shape[1]):
                p = (slots[:, :, j].T[:, :, None] * p[:, None, :]).reshape(len(q), -1)
            out.append(p)
        return out

    def visited(self, q: np.ndarray, counts: list[np.ndarray], enough: int) -> list[np.ndarray]:
        """(queries, buckets) of each table, true where the query looks."""
        out = []
        for p, n in zip(self.success(q), counts):
            p = p * (n > 0)
            order = np.argsort(-p, axis=1, kind="stable")
            total = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
            held = np.cumsum(n[order], axis=1)
            go_on = (total < self.share * total[:, -1:]) | (held < enough)
            take = np.column_stack([np.ones(len(q), bool), go_on[:, :-1]])
            seen = np.zeros_like(take)
            np.put_along_axis(seen, order, take, 1)
            out.append(seen & (n > 0))
        return out

    def _fit(self, sample: np.ndarray, long: np.ndarray, k: int) -> None:
        """Takes the least share of probability at which sample queries find RECALL of their true neighbours; these
        are farther away in a sample than among all rows, so the full index finds no fewer."""
        n = len(sample)
        k = min(k, n - 1)
        if k < 1:
            return
        q = sample[:SAMPLE_QUERIES]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        scale = self.longest * np.linalg.norm(q, axis=1)[:, None]
        self.cosine = float(np.clip((np.take_along_axis(score, near, 1) / np.maximum(scale, 1e-300)).mean(), 0.05, 0.99))
        cells = self.hashed(sample)
        counts = [np.bincount(c, minlength=self.cells) for c in cells]
        for self.share in SHARES:
            seen = self.visited(q, counts, k + 1)
            found = np.any([np.take_along_axis(s, c[near], 1) for s, c in zip(seen, cells)], axis=0)
            if found.mean() >= RECALL:
                return
        self.share = 1.0


def _layout(counts: list[np.ndarray], block: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each table: each bucket's first block, how many blocks it is split over, and the number of blocks."""
    out = []
    for n in counts:
        first, splits, at, room = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0, block
        for c in range(len(n)):
            if n[c] > block:
                at += room < block
                first[c], splits[c] = at, ceil(n[c] / block)
                at, room = at + splits[c], block
            else:
                if n[c] > room:
                    at, room = at + 1, block
                first[c], room = at, room - n[c]
        out.append((first, splits, at + 1))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids; scores of -inf are none."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge - 1e-9 * max(1.0, abs(edge))]
    return at


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, block: int = BLOCK, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found, nearest first, ties to smaller ids.

    ``is_query`` is a condition on the columns of ``vectors``.  Rows whose id or vector is null, whose vector is zero,
    holds null or non-finite components, or has another number of components than most have, take no part.  A row is
    no candidate for a query of its own id; a repeated id is listed once, with its best score.  With fewer candidates
    than ``k`` all are listed.  No rows, or no queries, give no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    x = F.col("x")
    sound = F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound)
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    answer = "query_id bigint, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("x") == most["dims"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toPandas()["x"]  # a bounded fit
    tables = Tables(np.array(sample.tolist(), np.float64), most["n"], sqrt(most["longest"]) * (1 + 1e-12), k)
    fitted = spark.sparkContext.broadcast(tables)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((TABLES, fitted.value.cells), np.int64)
        for b in batches:
            if len(b):
                for t, c in enumerate(fitted.value.hashed(np.array(b["x"].tolist(), np.float64))):
                    total[t] += np.bincount(c, minlength=fitted.value.cells)
        tab, cell = np.nonzero(total)
        yield pd.DataFrame({"tab": tab, "cell": cell, "n": total[tab, cell]})

    counts = [np.zeros(tables.cells, np.int64) for _ in range(TABLES)]
    for r in rows.select("x").mapInPandas(count, "tab int, cell int, n bigint").groupBy("tab", "cell").agg(F.sum("n").alias("n")).collect():  # at most TABLES * cells rows
        counts[r["tab"]][r["cell"]] = r["n"]
    plan = spark.sparkContext.broadcast((counts, _layout(counts, block)))
    parts = max(1, ceil(rows.where("asks").count() / group))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ids = b["id"].to_numpy()
            for t, c in enumerate(fitted.value.hashed(np.array(b["x"].tolist(), np.float64))):
                first, splits, _ = plan.value[1][t]
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pd.DataFrame({"tab": t, "block": first[c] + mixed.astype(np.int64) % splits[c], "id": ids, "cell": c, "x": b["x"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, layout = plan.value
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["x"].tolist(), np.float64)
            step = max(1, (1 << 18) // fitted.value.cells)  # a table of queries and buckets is made for few queries at a time
            each = [fitted.value.visited(x[i : i + step], counts, k + 1) for i in range(0, len(x), step)]
            for t in range(TABLES):
                s = np.concatenate([e[t] for e in each])
                first, splits, n = layout[t]
                packed = np.packbits(s, axis=1)
                into = np.zeros((len(b), n), bool)
                for c in np.flatnonzero(s.any(axis=0)):
                    into[:, first[c] : first[c] + splits[c]] |= s[:, c : c + 1]
                at, blocks = np.nonzero(into)
                yield pd.DataFrame({"tab": t, "block": blocks, "id": b["id"].to_numpy()[at], "cells": [packed[i].tobytes() for i in at], "x": b["x"].iloc[at]})

    kind = dict(rows.dtypes)["x"]
    indexed = rows.select("id", "x").mapInPandas(index, f"tab int, block bigint, id bigint, cell bigint, x {kind}")
    asked = rows.where("asks").select("id", "x").mapInPandas(ask, f"tab int, block bigint, id bigint, cells binary, x {kind}")

    def match(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            held = held.sort_values("cell", kind="stable")
            x, q = np.array(held["x"].tolist(), np.float64), np.array(queries["x"].tolist(), np.float64)
            ids, cells, asking = held["id"].to_numpy(), held["cell"].to_numpy(), queries["id"].to_numpy()
            stops = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for i in range(0, len(q), 64):
                looks = np.unpackbits(np.frombuffer(b"".join(queries["cells"].iloc[i : i + 64]), np.uint8).reshape(len(asking[i : i + 64]), -1), axis=1).astype(bool)
                scores = np.full((len(looks), len(ids)), -np.inf)
                for a, b in zip(stops, stops[1:]):  # bucket by bucket
                    on = np.flatnonzero(looks[:, cells[a]])
                    if len(on):
                        scores[on, a:b] = q[i + on] @ x[a:b].T
                scores[asking[i : i + 64, None] == ids] = -np.inf
                for j, s in enumerate(scores, i):
                    at = _best(ids, s, k)
                    exact = (x[at] * q[j]).sum(axis=1)  # the same order of sums for every pair
                    best = np.lexsort((ids[at], -exact))
                    best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:k]
                    out.append(pd.DataFrame({"query_id": asking[j], "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    indexed = indexed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    found = asked.groupBy("tab", "block", "part").cogroup(indexed.groupBy("tab", "block", "part")).applyInPandas(match, answer)
    found = scratch.write(found, "found").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
