"""Adjacency, degrees, the inverted index, and the scores of queries against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions import text as T
from lodestrand.functions.hashing import unsigned
from lodestrand.functions.paths import basename, is_vendor


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge at both its ends: id, other_id, kind, outgoing, seq.  One scan of the edges, no shuffle."""
    ends = F.array(
        F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), F.lit(True).alias("outgoing")),
        F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), F.lit(False).alias("outgoing")),
    )
    return edges.select("kind", "seq", F.explode(ends).alias("end")).select("end.id", "end.other_id", "kind", "end.outgoing", "seq")


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree, dangling ends included; counted in each task before the shuffle."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def postings(symbols: DataFrame, edges: DataFrame, prefixes: tuple[str, ...] = K.PUBLIC_PREFIXES) -> DataFrame:
    """token, id, base_score: the inverted index."""
    known = symbols.where(F.col("kind") != K.UNKNOWN).join(degrees(edges), "id", "left")
    tokens = F.explode(T.symbol_tokens(F.col("name"), F.col("file"), F.col("scope"), F.col("signature")))
    # the score is a projection above the explode: nothing but token and symbol columns is needed
    each = known.withColumn("token", tokens)
    return each.select("token", "id", S.token_score(F.col("token"), S.hub_bonus(F.col("degree")), prefixes).alias("base_score"))


def terms_table(symbols: DataFrame, text: str) -> DataFrame:
    """pos and term of a query, at most ``MOST_TERMS`` rows."""
    one = symbols.sparkSession.range(1)
    return one.select(F.posexplode(T.terms(F.lit(text))).alias("pos", "term"))


def matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """id, pos, is_prefix, weight: tokens equal to a term, and at half weight those that a term of four letters or
    more begins.  Both are equi-joins with the few terms, which are broadcast."""
    terms = F.broadcast(terms)
    exact = index.join(terms, F.col("token") == F.col("term")).select("id", "pos", F.lit(0).alias("is_prefix"), F.col("base_score").alias("weight"))
    heads = terms.where(F.length("term") >= 4).select("pos", "term", F.left("term", F.lit(4)).alias("head"))
    begun = index.withColumn("head", F.left("token", F.lit(4))).join(heads, "head").where(F.col("token").startswith(F.col("term")) & (F.col("token") != F.col("term")))
    return exact.unionByName(begun.select("id", "pos", F.lit(1).alias("is_prefix"), (F.col("base_score") * 0.5).alias("weight")))


def scores(found: DataFrame) -> DataFrame:
    """id and score: weights added up, and 8 for each hit; prefixes are a hit only where they come first."""
    first = F.min(F.col("pos") * 2 + F.col("is_prefix")) % 2
    hits = F.sum(1 - F.col("is_prefix")) + first
    return found.groupBy("id").agg((F.sum("weight") + 8 * hits).alias("score")).where(F.col("score") >= K.LEAST_SCORE)


def top(scored: DataFrame, most: int = K.MOST_SEEDS) -> DataFrame:
    return scored.orderBy(F.desc("score"), unsigned(F.col("id"))).limit(most)


def task_seeds(symbols: DataFrame, edges: DataFrame, text: str, most: int = K.MOST_SEEDS) -> DataFrame:
    return top(scores(matches(postings(symbols, edges), terms_table(symbols, text))), most)


def field_scores(symbols: DataFrame, terms: Column) -> DataFrame:
    """id and score of symbols against all terms, field by field; those that no term hits are left out.

    ``terms`` is an array beside each symbol, so no row is multiplied.
    """
    c, name = F.col, F.lower(F.col("name"))

    def per_term(t):
        has = lambda text: T.contains_folded(text, t, False)
        parts = (
            F.when(name == t, 40.0).when(has(c("name")), 18.0).otherwise(0.0),
            F.when(has(basename(c("file"))), 10.0).otherwise(0.0),
            F.when(has(c("file")), 6.0).otherwise(0.0),
            F.when(has(c("signature")), 5.0).otherwise(0.0),
            F.when(has(c("scope")), 4.0).otherwise(0.0),
        )
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    rows = symbols.where(F.col("kind") != K.UNKNOWN).withColumn("per_term", F.transform(terms, per_term))
    covered = F.size(F.filter("per_term", lambda x: x > 0))
    total = F.aggregate("per_term", F.lit(0.0), lambda a, b: a + b) + covered * 8 + S.kind_importance(c("kind"))
    total = total + F.when(c("is_definition"), 6.0).otherwise(0.0) + F.when(S.is_public_entrypoint(), 14.0).otherwise(0.0)
    total = total + F.when(S.has_public_prefix(c("name")), 6.0).otherwise(0.0) + F.when(c("scope") != "", 2.0).otherwise(0.0)
    return rows.where(covered > 0).select("id", F.when(is_vendor(c("file")), total * 0.3).otherwise(total).alias("score"))


def symbol_anchor_scores(symbols: DataFrame, text: str) -> DataFrame:
    """The anchor is the text up to the first white space: its name, part of its name, or else the field scores."""
    anchor = F.lit(text.split(None, 1)[0] if text.split() and not text[0].isspace() else "")
    whole = F.lower("name") == F.lower(anchor)
    part = T.contains_folded(F.col("name"), anchor, False)
    by_field = field_scores(symbols, T.terms(F.lit(text))).withColumnRenamed("score", "field_score")
    score = F.when(whole, 200.0 + S.kind_importance(F.col("kind"))).when(part, 100.0 + S.kind_importance(F.col("kind"))).otherwise(F.coalesce("field_score", F.lit(0.0)))
    return symbols.join(by_field, "id", "left").select("id", score.alias("score")).where(F.col("score") >= K.LEAST_SCORE)


def file_anchor_scores(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file") == path).select("id", (200.0 + S.kind_importance(F.col("kind"))).alias("score"))
