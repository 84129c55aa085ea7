"""What the corpus operators share: intermediate tables, shipping of code, and plain column helpers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.scratch import Scratch, shared_dir  # noqa: F401

#: The ASCII white space that the operators' contracts name.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

# Functions of this package travel to the executors by value: they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["lodestrand"])


def normal_space(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def id_order(id_col: str, row_col: str) -> Column:
    """Sorts by id with nulls last, then by row; ``min`` of it picks one row of any group."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
