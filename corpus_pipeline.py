"""A corpus pipeline of five stages: quality classifier, exact dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is the Parquet table that the stage before wrote.
All stages but the last return the columns of documents.  Null texts count as empty ones and pass through as null.
Null and repeated ids do no harm: where a stage has to tell rows apart, it first writes them with a number of their own
to the shared folder, so that the numbers are the same whatever executors read them later.  Of rows that also share the id
the first one stays.  Very long texts are read whole; further columns pass through; a stage without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import exact_dedup, near, packing, quality, secret_scan, simhash
from lodestrand.llm.common import Scratch, table

ROW = "__pipeline_row"
TAIL = ("__expected_grade", "__tail_probability", "__kept")


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, as written: how the files are dealt to tasks may differ between two reads."""
    return Scratch(docs.sparkSession, "rows").write(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier rejects go: toxic and poor ones.  It is fitted on the rated
    documents of ``sf_dir`` (at most ``quality.FIT_ROWS`` of them)."""
    model = quality.train(table(spark, sf_dir, "documents"), quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, names=TAIL).where(F.col(TAIL[2])).drop(*TAIL)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    rows = _rows(docs)
    kept = exact_dedup.exact_dedup(rows, row_col=ROW).where("kept").select(F.col("row_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.  Groups are connected by
    pairs whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    rows = _rows(docs)
    kept = simhash.survivors(near.near_dedup(rows, ROW)).select(F.col("row_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars follows; every document stays."""
    return secret_scan.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-dedup", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Classifier, fingerprints and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
