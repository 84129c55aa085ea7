"""Point queries that a handle asks for: files, entrypoints, relations, and lines of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.operators.retrieve import relations


def file_map(symbols: DataFrame, path: str) -> DataFrame:
    """The symbols of a file by section (entrypoint, internal, omitted) and place in it."""
    rows = symbols.where((F.col("file") == path) & ~F.col("kind").isin(K.UNKNOWN, K.INCLUDE))
    rows = rows.withColumn("is_public", S.is_public_entrypoint())
    by_class = F.row_number().over(Window.partitionBy("is_public").orderBy("seq"))
    rows = rows.withColumn("n", by_class)
    room = F.when(F.col("is_public"), K.FILE_ENTRYPOINTS).otherwise(K.FILE_INTERNALS)
    section = F.when(F.col("n") > room, "omitted").when(F.col("is_public"), "entrypoint").otherwise("internal")
    rows = rows.withColumn("section", section)
    place = F.row_number().over(Window.partitionBy("section").orderBy("seq"))
    rows = rows.withColumn("place", place).where((F.col("section") != "omitted") | (F.col("place") <= K.FILE_OMITTED))
    return rows.select("section", "place", *symbols.columns)


def file_totals(symbols: DataFrame, path: str) -> DataFrame:
    """total, entrypoints, internals, listed, omitted of a file."""
    rows = symbols.where((F.col("file") == path) & ~F.col("kind").isin(K.UNKNOWN, K.INCLUDE))
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(S.is_public_entrypoint()).alias("entrypoints"))
    counts = counts.withColumn("internals", F.col("total") - F.col("entrypoints"))
    counts = counts.withColumn("listed", F.least("entrypoints", F.lit(K.FILE_ENTRYPOINTS)) + F.least("internals", F.lit(K.FILE_INTERNALS)))
    return counts.withColumn("omitted", F.col("total") - F.col("listed"))


def entrypoints(symbols: DataFrame, path: str, most: int = K.FILE_ENTRYPOINTS) -> DataFrame:
    return symbols.where((F.col("file") == path) & S.is_public_entrypoint()).orderBy("seq").limit(most)


def related(symbols: DataFrame, edges: DataFrame, id: int, kind: int, direction: int) -> DataFrame:
    """Symbols at the other ends of a symbol's edges: into it (-1), out of it (1), or both (0)."""
    near = relations(edges.where((F.col("from_id") == id) | (F.col("to_id") == id)), symbols).where((F.col("id") == id) & (F.col("kind") == kind))
    if direction:
        near = near.where(F.col("outgoing") == F.lit(direction > 0))
    return near.select("other_id", "other_kind", "other_name", "other_file", "other_line", "outgoing", "seq")


def all_relations(symbols: DataFrame, edges: DataFrame, id: int, most: int = 256) -> DataFrame:
    """Every relation of a symbol in order, of both directions."""
    near = relations(edges.where((F.col("from_id") == id) | (F.col("to_id") == id)), symbols).where(F.col("id") == id)
    return near.orderBy("seq", "other_id", "kind", "outgoing").limit(most).drop("id")


def clamped(start: Column, end: Column, line: Column, end_line: Column) -> tuple[Column, Column]:
    """A range of lines held inside a symbol's own."""
    low = F.greatest(start, line)
    high = F.least(end, F.greatest(end_line, line))
    return low, F.greatest(high, low)


def lines_of(texts: DataFrame, start: Column, end: Column, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The keys, number (from 1) and content of the lines of each text from start to end."""
    lines = F.split(F.col(text_col), "\n")
    low, count = F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))
    cut = F.slice(lines, low, count)
    each = texts.select(*keys, low.alias("low"), F.posexplode(cut).alias("at", "content"))
    return each.select(*keys, (F.col("at") + F.col("low")).cast("int").alias("number"), "content")


def numbered(number: Column, content: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 5, " "), F.lit(" | "), content)
