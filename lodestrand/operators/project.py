"""A part of the graph for drawing: which nodes, which edges, where they start, and how they move."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions.hashing import fnv64, unit_float, unsigned
from lodestrand.functions.paths import dirname
from lodestrand.operators.index import degrees

PALETTE = 10
# Time step, repulsion, spring, rest length, pull to the centre, pull to the module, repulsion inside a
# module, damping, and the bound of speed.
STEP, REPULSION, SPRING, REST, CENTRE, COHESION, INSIDE, DAMPING, FASTEST = 0.62, 1800.0, 0.0048, 95.0, 0.004, 0.06, 0.22, 0.82, 30.0


def colour(hashed: Column) -> Column:
    """The unsigned hash modulo the palette."""
    return (((F.shiftrightunsigned(hashed, 1) % PALETTE) * 2 + hashed.bitwiseAND(F.lit(1))) % PALETTE).cast("int")


def node_candidates(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with degree and weight.  With over 100 connected ones those without edges go, and unknown ones always."""
    rows = symbols.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    connected = F.broadcast(rows.agg(F.count_if(F.col("degree") > 0).alias("connected")))  # one row
    rows = rows.crossJoin(connected).where((F.col("degree") > 0) | ((F.col("connected") <= 100) & (F.col("kind") != K.UNKNOWN))).drop("connected")
    weight = F.when(F.col("degree") > 0, 180).otherwise(0) + F.when(F.col("is_definition"), 40).otherwise(0) + S.graph_kind_score(F.col("kind")) + F.col("degree") * 24
    return rows.withColumn("weight", weight.cast("bigint"))


def project_nodes(symbols: DataFrame, edges: DataFrame, most: int = K.GRAPH_NODES) -> DataFrame:
    """The heaviest nodes with radius, module colour and first place."""
    top = node_candidates(symbols, edges).orderBy(F.desc("weight"), F.desc("degree"), unsigned(F.col("id"))).limit(most)
    radius = F.greatest(F.lit(4.0), F.least(F.lit(12.0), 3.5 + F.sqrt(F.col("degree") + 1) * 0.6))
    angle, far = unit_float(F.col("id")) * (2 * pi), F.lit(80.0) + unit_float(F.col("id").bitwiseXOR(F.lit(0xA531))) * 420.0
    return top.withColumn("hashed", fnv64(dirname(F.col("file")))).select("id", "name", "file", "kind", "degree", "weight", radius.alias("radius"), colour(F.col("hashed")).alias("module_colour"), (F.cos(angle) * far).alias("x"), (F.sin(angle) * far).alias("y"))


def project_edges(edges: DataFrame, nodes: DataFrame, most: int = K.GRAPH_EDGES) -> DataFrame:
    """Edges with both ends among the nodes, no loops, the first ``most``."""
    ids = F.broadcast(nodes.select("id"))  # at most GRAPH_NODES rows
    inside = edges.where("from_id <> to_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return inside.orderBy("seq", "from_id", "to_id", "kind").limit(most).select("from_id", "to_id", "kind", "seq")


def placed(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Nodes with the place and speed that they had before, or their first place at rest."""
    if before is None:
        return nodes.withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0))
    old = before.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("vx").alias("ovx"), F.col("vy").alias("ovy"))
    joined = nodes.join(old, "id", "left")
    return joined.select(*[c for c in nodes.columns if c not in ("x", "y", "vx", "vy")], F.coalesce("ox", "x").alias("x"), F.coalesce("oy", "y").alias("y"), F.coalesce("ovx", F.lit(0.0)).alias("vx"), F.coalesce("ovy", F.lit(0.0)).alias("vy"))


def module_centroids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("module_colour").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def kinetic_energy(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("energy"))


def nearest_node(nodes: DataFrame, x: float, y: float, reach: float | None = None) -> DataFrame:
    """The node under a point: within its radius, or within ``reach``."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    bound = F.lit(reach) if reach is not None else F.col("radius")
    return nodes.withColumn("d2", d2).where(F.col("d2") <= bound * bound).orderBy("d2", "id").limit(1)


def moved(nodes: pd.DataFrame, edges: pd.DataFrame, steps: int = 1) -> pd.DataFrame:
    """Positions and speeds after some steps of the forces; nodes are at most GRAPH_NODES rows."""
    nodes = nodes.sort_values("id").reset_index(drop=True)
    p, v = nodes[["x", "y"]].to_numpy(float), nodes[["vx", "vy"]].to_numpy(float)
    module = nodes["module_colour"].to_numpy()
    at = pd.Series(nodes.index, index=nodes["id"])
    a, b = at.reindex(edges["from_id"]).to_numpy(), at.reindex(edges["to_id"]).to_numpy()
    known = ~(np.isnan(a.astype(float)) | np.isnan(b.astype(float)))
    a, b = a[known].astype(int), b[known].astype(int)
    same = module[:, None] == module[None, :]
    size = same.sum(axis=1)
    for _ in range(steps):
        force = -p * CENTRE
        centroid = same @ p / size[:, None]
        force += np.where(size[:, None] > 1, (centroid - p) * COHESION, 0.0)
        d = p[:, None, :] - p[None, :, :]
        d2 = (d * d).sum(axis=2) + 24.0
        push = REPULSION * np.where(same, INSIDE, 1.0) / (d2 * np.sqrt(d2))
        np.fill_diagonal(push, 0.0)
        force += (d * push[:, :, None]).sum(axis=1)
        line = p[b] - p[a]
        length = np.sqrt((line * line).sum(axis=1)) + 0.001
        pull = line / length[:, None] * ((length - REST) * SPRING)[:, None]
        np.add.at(force, a, pull)
        np.add.at(force, b, -pull)
        v = np.clip((v + force * STEP) * DAMPING, -FASTEST, FASTEST)
        p = p + v
    return nodes.assign(x=p[:, 0], y=p[:, 1], vx=v[:, 0], vy=v[:, 1])


def force_steps(nodes: DataFrame, edges: DataFrame, steps: int = 1) -> DataFrame:
    """``moved`` on a projection.  All pairs of a bounded set push each other, so one task has the whole set."""
    packed = edges.select("from_id", "to_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("edges"))
    columns = ["id", "module_colour", "x", "y", "vx", "vy"]
    one = nodes.select(*columns).agg(F.collect_list(F.struct(*columns)).alias("nodes")).crossJoin(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                n = pd.DataFrame(list(row.nodes), columns=columns)
                e = pd.DataFrame(list(row.edges), columns=["from_id", "to_id"])
                yield moved(n, e, steps)[["id", "x", "y", "vx", "vy"]]

    return one.mapInPandas(run, "id bigint, x double, y double, vx double, vy double")
