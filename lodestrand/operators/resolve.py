"""Name resolution: unresolved edges become edges between symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.hashing import symbol_id, unsigned
from lodestrand.functions.paths import dirname
from lodestrand.functions.symbols import kind_resolution


def _best(symbols: DataFrame, name: str, *near: Column) -> DataFrame:
    """The best symbol of each name, or of each name and place: worth by definition and kind, then smallest unsigned id."""
    worth = F.when(F.col("is_definition"), 20).otherwise(0) + kind_resolution(F.col("kind"))
    order = F.struct(worth.alias("score"), (-1 - unsigned(F.col("id"))).alias("rank"))
    return symbols.groupBy(F.col("name").alias(name), *near).agg(F.max(order).alias("best"))


def best_candidate(pending: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """seq, candidate id and its score for every unresolved edge whose ``name`` some symbol has.

    Same file counts 100, else same module 40; a definition 20; then the kind; ties go to the smallest unsigned id.
    Candidates are reduced first, in each task before the shuffle, to the best of each name, of each name and module, and
    of each name and file; three equi-joins bring one row each to a call site, and the best of the three is the best of
    all.  So a name with many symbols and many call sites costs their sum, not their product.
    """
    place = dirname(F.col("file"))
    by_name = _best(symbols, name).withColumnRenamed("best", "any")
    by_module = _best(symbols.where(place != ""), name, place.alias("module")).withColumnRenamed("best", "mate")
    by_file = _best(symbols, name, F.col("file").alias("caller_file")).withColumnRenamed("best", "own")
    sites = pending.select("seq", "caller_file", dirname(F.col("caller_file")).alias("module"), name)
    found = sites.join(by_name, name).join(by_module, [name, "module"], "left").join(by_file, [name, "caller_file"], "left")
    at = lambda c, near: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.score") + near).alias("score"), F.col(f"{c}.rank").alias("rank")))
    best = found.select("seq", F.greatest(at("any", 0), at("mate", 40), at("own", 100)).alias("best"))
    return best.select("seq", unsigned(-1 - F.col("best.rank")).alias("id"), F.col("best.score").alias("score"))


def resolved_targets(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    return best_candidate(pending, symbols, "callee_name").select("seq", F.col("id").alias("target_id"), "score")


def _source(found: Column) -> Column:
    site = F.coalesce("caller_name", "callee_name")
    return F.coalesce(found, symbol_id(F.coalesce("caller_file", F.lit("")), site, F.col("caller_line")))


def resolved_edges(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_id, to_id, kind, seq of every edge that resolves; sources without a symbol get an id from their place.
    Edges of a symbol to itself are dropped, and of equal edges the first stays."""
    targets = resolved_targets(pending, symbols).select("seq", "target_id")
    sources = best_candidate(pending.where("caller_name is not null"), symbols, "caller_name").select("seq", F.col("id").alias("source_id"))
    whole = pending.join(targets, "seq").join(sources, "seq", "left")
    edges = whole.select(_source(F.col("source_id")).alias("from_id"), F.col("target_id").alias("to_id"), "kind", "seq").where("from_id <> to_id")
    return edges.groupBy("from_id", "to_id", "kind").agg(F.min("seq").alias("seq"))


def resolution_counts(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """pending, found and missed."""
    whole = pending.select("seq").join(resolved_targets(pending, symbols), "seq", "left")
    return whole.agg(F.count(F.lit(1)).alias("pending"), F.count("target_id").alias("found"), F.count_if(F.col("target_id").isNull()).alias("missed"))
