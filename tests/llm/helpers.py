"""Small tables that every corpus operator has to cope with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "alpha beta gamma " * 30_000
ODD_TEXTS = [None, "", " ", "\t\n", "one", "one two", "one  two", "One Two three", "é 漢 🎉 x", "x" * 5000, LONG, LONG + "delta", "a\x0bb", "nbsp here"]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Null and repeated ids and texts, ties, repeated rows, long texts, and columns named like those of results."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "one two"), (None, None), (3, "one two"), (3, "one two"), (50, "one"), (51, "one"), (-4, "one")]
    out = [(i, t, "fp", "c", i, 1.5, True, None, "k", 7) for i, t in rows]
    return spark.createDataFrame(out, "doc_id bigint, text string, fingerprint string, component_id string, row_id bigint, expected_grade double, kept boolean, spans string, key string, n bigint")


def no_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).limit(0)


def as_table(spark: SparkSession, df: DataFrame, path) -> DataFrame:
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
