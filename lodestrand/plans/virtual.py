"""A code graph over plain tables: symbols of parts and suppliers, edges and unresolved edges of line items.

``GRAPH_SQL`` is the same in SQL, as the prefix of oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Symbols, edges and unresolved edges of one generation, and its files."""

    symbols: DataFrame
    edges: DataFrame
    pending: DataFrame | None = None
    files: DataFrame | None = None


def virtual_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    symbols = _symbols(t("part"), t("supplier"))
    return Graph(symbols, _edges(t("lineitem")), _pending(t("lineitem"), symbols), _files(symbols))


def _symbols(part: DataFrame, supplier: DataFrame) -> DataFrame:
    key, brand, name = F.col("p_partkey"), F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_name", " ", "_")
    parts = part.select(
        key.cast("bigint").alias("id"),
        name.alias("name"),
        F.concat(F.lit("/repo/"), F.when(key % 10 == 0, "vendor/").otherwise(""), brand, F.lit("/"), F.lower("p_type"), F.lit(".c")).alias("file"),
        F.col("p_size").cast("int").alias("line"),
        F.lit(1).alias("col"),
        (F.col("p_size") + key % 7).cast("int").alias("end_line"),
        (key % 11).cast("int").alias("kind"),
        F.concat(F.when(key % 5 == 0, "static ").otherwise(""), F.lit("int "), name, F.lit("(void)")).alias("signature"),
        F.when(key % 3 == 0, brand).otherwise("").alias("scope"),
        (key % 7).cast("int").alias("lang"),
        (key % 4 != 0).alias("is_definition"),
        key.cast("bigint").alias("seq"),
    )
    key, name = F.col("s_suppkey"), F.lower(F.regexp_replace("s_name", "#", "_"))
    line = (key % 500 + 1).cast("int")
    suppliers = supplier.select(
        (key + 10000000).cast("bigint").alias("id"),
        name.alias("name"),
        F.concat(F.lit("/repo/supplier/n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("file"),
        line.alias("line"),
        F.lit(1).alias("col"),
        (line + key % 3).cast("int").alias("end_line"),
        F.lit(0).alias("kind"),
        F.concat(F.lit("def "), name, F.lit("(self):")).alias("signature"),
        F.lit("").alias("scope"),
        F.lit(2).alias("lang"),
        F.lit(True).alias("is_definition"),
        (key + 10000000).cast("bigint").alias("seq"),
    )
    return parts.unionByName(suppliers)


def _edges(lineitem: DataFrame) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    bought = lineitem.select(F.col("l_partkey").alias("from_id"), (F.col("l_suppkey") + 10000000).alias("to_id"), (F.col("l_linenumber") % 5).cast("int").alias("kind"), seq.alias("seq"))
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    follow = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_id"))
    chained = lines.join(follow, ["l_orderkey", "l_linenumber"]).where("l_partkey <> to_id").select(F.col("l_partkey").alias("from_id"), "to_id", F.lit(0).alias("kind"), seq.alias("seq"))
    return bought.unionByName(chained).groupBy("from_id", "to_id", "kind").agg(F.min("seq").alias("seq"))


def _pending(lineitem: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    # numbered inside each order: unique, and no sort of the whole table
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    callers = symbols.select(F.col("id").alias("l_partkey"), F.col("file").alias("caller_file"), F.col("name").alias("caller"))
    callees = symbols.select(F.col("id").alias("t"), F.col("name").alias("callee"))
    whole = rows.withColumn("t", F.col("l_partkey") * 7 % 150 + 1).join(callers, "l_partkey").join(callees, "t")
    line = F.col("l_linenumber") % 3
    return whole.select(
        "caller_file",
        F.when(F.col("l_linenumber") != 7, F.col("caller")).alias("caller_name"),
        F.when(F.col("l_orderkey") % 9 == 0, "unresolved_fn").otherwise(F.col("callee")).alias("callee_name"),
        (F.col("l_orderkey") % 900 + 1).cast("int").alias("caller_line"),
        F.when(line == 0, 0).when(line == 1, 3).otherwise(4).alias("kind"),
        (F.col("l_orderkey") * 100 + F.col("n")).alias("seq"),
    )


def _files(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.col("file").alias("path")).agg(F.max("line").cast("bigint").alias("mtime"), (F.count(F.lit(1)) * 97).alias("size"), F.min("lang").alias("lang"), F.lit(0).alias("error_count"))


GRAPH_SQL = """
WITH RECURSIVE v_symbols AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, replace(p_name, ' ', '_') AS name,
         '/repo/' || CASE WHEN p_partkey % 10 = 0 THEN 'vendor/' ELSE '' END || replace(p_brand, '#', '') || '/' || lower(p_type) || '.c' AS file,
         CAST(p_size AS INT) AS line, CAST(1 AS INT) AS col, CAST(p_size + p_partkey % 7 AS INT) AS end_line, CAST(p_partkey % 11 AS INT) AS kind,
         CASE WHEN p_partkey % 5 = 0 THEN 'static ' ELSE '' END || 'int ' || replace(p_name, ' ', '_') || '(void)' AS signature,
         CASE WHEN p_partkey % 3 = 0 THEN replace(p_brand, '#', '') ELSE '' END AS scope,
         CAST(p_partkey % 7 AS INT) AS lang, (p_partkey % 4 <> 0) AS is_definition, CAST(p_partkey AS BIGINT) AS seq
  FROM part
  UNION ALL
  SELECT CAST(10000000 + s_suppkey AS BIGINT), lower(replace(s_name, '#', '_')), '/repo/supplier/n' || CAST(s_nationkey AS VARCHAR) || '.py',
         CAST(s_suppkey % 500 + 1 AS INT), CAST(1 AS INT), CAST(s_suppkey % 500 + 1 + s_suppkey % 3 AS INT), CAST(0 AS INT),
         'def ' || lower(replace(s_name, '#', '_')) || '(self):', '', CAST(2 AS INT), true, CAST(10000000 + s_suppkey AS BIGINT)
  FROM supplier
), v_edges AS (
  SELECT from_id, to_id, kind, MIN(seq) AS seq FROM (
    SELECT CAST(l_partkey AS BIGINT) AS from_id, CAST(10000000 + l_suppkey AS BIGINT) AS to_id, CAST(l_linenumber % 5 AS INT) AS kind, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq
    FROM lineitem
    UNION ALL
    SELECT CAST(a.l_partkey AS BIGINT), CAST(b.l_partkey AS BIGINT), CAST(0 AS INT), CAST(a.l_orderkey * 10 + a.l_linenumber AS BIGINT)
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_partkey <> b.l_partkey
  ) x GROUP BY from_id, to_id, kind
), v_pending AS (
  SELECT c.file AS caller_file, CASE WHEN l.l_linenumber = 7 THEN NULL ELSE c.name END AS caller_name,
         CASE WHEN l.l_orderkey % 9 = 0 THEN 'unresolved_fn' ELSE t.name END AS callee_name, CAST(l.l_orderkey % 900 + 1 AS INT) AS caller_line,
         CAST(CASE l.l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END AS INT) AS kind,
         CAST(l.l_orderkey * 100 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey) AS BIGINT) AS seq
  FROM lineitem l JOIN v_symbols c ON c.id = l.l_partkey JOIN v_symbols t ON t.id = (l.l_partkey * 7) % 150 + 1
), v_files AS (
  SELECT file AS path, CAST(MAX(line) AS BIGINT) AS mtime, CAST(COUNT(*) * 97 AS BIGINT) AS size, MIN(lang) AS lang, CAST(0 AS INT) AS error_count
  FROM v_symbols GROUP BY file
), adj AS (
  SELECT from_id AS id, to_id AS other_id, kind, true AS outgoing, seq FROM v_edges
  UNION ALL SELECT to_id, from_id, kind, false, seq FROM v_edges
), deg AS (SELECT id, COUNT(*) AS degree FROM adj GROUP BY id
), flags AS (
  SELECT s.*, regexp_matches(file, '/(vendor|vendors|third_party|thirdparty|external|deps)/') AS vendor,
         regexp_matches(lower(signature), 'static[ \\t]') AS static_marked,
         regexp_replace(file, '/[^/]*$', '') AS module, regexp_replace(file, '^.*/', '') AS base,
         list_value(10, 10, 8, 8, 6, 6, 4, 4, 1, 5, 0)[kind + 1] AS importance,
         list_value('fn', 'method', 'class', 'struct', 'enum', 'typedef', 'var', 'macro', 'include', 'ns', 'node')[kind + 1] AS label,
         CAST(least(12.0, coalesce(degree, 0) * 0.15) AS DOUBLE) AS hub
  FROM v_symbols s LEFT JOIN deg USING (id)
), sym AS (
  SELECT *, (NOT vendor AND scope = '' AND NOT static_marked AND ((kind IN (0, 1) AND end_line > line) OR (kind IN (2, 3, 4, 5) AND is_definition))) AS public_entry,
         (starts_with(name, 'ctx_') OR starts_with(name, 'Ctx')) AS prefixed
  FROM flags
)
"""
