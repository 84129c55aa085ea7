"""Paged tables of symbols, calls and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions.paths import basename, dirname, size_label
from lodestrand.functions.text import contains_folded


def _any_contains(query: str, *texts: Column) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | contains_folded(t, F.lit(query), True)
    return out


def symbol_rows(symbols: DataFrame, query: str = "") -> DataFrame:
    """Definitions that match: seq, id, and the columns shown."""
    c, label = F.col, S.kind_list_label(F.col("kind"))
    rows = symbols.where(c("is_definition") & _any_contains(query, c("name"), c("file"), c("scope"), c("signature"), label))
    return rows.select("seq", "id", label.alias("kind"), "name", basename(c("file")).alias("file"), "line", F.when(c("scope") == "", "-").otherwise(c("scope")).alias("scope"))


def call_rows(symbols: DataFrame, edges: DataFrame, query: str = "") -> DataFrame:
    """Calls that match, with both ends where these are known."""
    end = lambda side: symbols.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("file").alias(f"{side}_file"), F.col("line").alias(f"{side}_line"))
    rows = edges.where(F.col("kind") == K.CALLS).join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    name = {s: F.coalesce(f"{s}_name", F.lit("?")) for s in ("from", "to")}
    file = {s: F.coalesce(f"{s}_file", F.lit("")) for s in ("from", "to")}
    rows = rows.where(_any_contains(query, name["from"], file["from"], name["to"], file["to"], F.lit("calls")))
    line = F.coalesce("from_line", F.lit(0))
    return rows.select("seq", "from_id", "to_id", name["from"].alias("from_name"), name["to"].alias("to_name"), F.lit("calls").alias("kind"), basename(file["from"]).alias("from_file"), line.alias("from_line"))


def definition_counts(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_definition").groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_symbols"))


def file_rows(files: DataFrame, symbols: DataFrame, query: str = "") -> DataFrame:
    """Files that match, with their definitions counted."""
    c, short = F.col, S.lang_short(F.col("lang"))
    rows = files.where(_any_contains(query, c("path"), basename(c("path")), short)).join(definition_counts(symbols), "path", "left")
    errors = F.when(c("error_count") > 0, c("error_count").cast("string")).otherwise("-")
    folder = dirname(c("path"))
    return rows.select("path", basename(c("path")).alias("name"), short.alias("lang"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), size_label(c("size")).alias("size"), errors.alias("errors"), F.when(folder == "", ".").otherwise(folder).alias("dir"))


def page(rows: DataFrame, number: int, *order: str, size: int = K.PAGE_SIZE) -> tuple[DataFrame, int, int]:
    """A page of the rows in order, their total, and the page's number held to the last page."""
    total = rows.count()
    number = max(0, min(number, max(0, (total - 1) // size)))
    return rows.orderBy(*order).offset(number * size).limit(size), total, number
