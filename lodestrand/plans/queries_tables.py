"""Queries over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import paths as P
from lodestrand.functions import text as T
from lodestrand.operators import expand, store
from lodestrand.streaming import maintain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


STOP_LIST = ", ".join(f"'{w}'" for w in K.STOPWORDS)
STEM_SQL = "CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
TERMS_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9_]{{1,63}})[A-Za-z0-9_]?', 1) AS ws FROM documents),
each AS (SELECT doc_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM words),
stems AS (SELECT doc_id, pos, {STEM_SQL} AS t FROM each),
firsts AS (SELECT doc_id, t, min(pos) AS pos FROM stems WHERE length(t) >= 2 AND t NOT IN ({STOP_LIST}) GROUP BY doc_id, t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM firsts),
joined AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS terms FROM ranked WHERE r <= {K.MOST_TERMS} GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.terms, '') AS terms FROM documents d LEFT JOIN joined j USING (doc_id)
"""


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("origin"), F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    items = _table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").cast("string").alias("key"), "text")
    return turns.unionByName(items).select("origin", "key", T.intent(F.col("text")).alias("intent"), T.estimated_tokens(F.col("text")).alias("tokens"))


def _intent_sql(column: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f"contains(lower({column}), '{w}')" for w in words)} THEN '{name}'" for name, words in K.INTENT_RULES)
    return f"CASE {rules} ELSE 'unknown' END"


INTENT_SQL = f"""
WITH t AS (SELECT 'conversation' AS origin, conv_id || '-' || turn AS key, text FROM conversations
           UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark)
SELECT origin, key, {_intent_sql('text')} AS intent, CAST(strlen(text) // 4 + 1 AS BIGINT) AS tokens FROM t
"""


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    root = F.substring_index("path", "/", 1)
    out = rows.select("page_id", P.basename(F.col("path")).alias("base"), P.dirname(F.col("path")).alias("dir"), P.display(F.col("path"), root).alias("shown"), P.is_vendor(F.col("path")).alias("vendor"), P.language(F.col("path")).alias("lang"), P.in_skipped_dir(P.dirname(F.col("path"))).alias("skipped"))
    return out


EXTENSION_SQL = " ".join(f"WHEN '{e}' THEN {c}" for e, c in K.EXTENSIONS.items())
PATHS_SQL = rf"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages),
q AS (SELECT *, split_part(path, '/', 1) AS root, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM p)
SELECT page_id, regexp_replace(path, '^.*/', '') AS base, dir,
       CASE WHEN root = '' THEN path WHEN path = root THEN '.' WHEN starts_with(path, root || '/') THEN substr(path, length(root) + 2) ELSE path END AS shown,
       regexp_matches(path, '/(vendor|vendors|third_party|thirdparty|external|deps)/') AS vendor,
       CAST(CASE regexp_extract(path, '\.([^.]*)$', 1) {EXTENSION_SQL} ELSE 7 END AS INT) AS lang,
       len(list_filter(string_split(dir, '/'), lambda d: (starts_with(d, '.') AND d <> '') OR d IN ({', '.join(f"'{d}'" for d in K.SKIPPED_DIRS)}))) > 0 AS skipped
FROM q
"""


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda name: P.url_parameter(F.col("url"), name).alias(name)
    return _table(spark, sf_dir, "pages").select("page_id", *map(value, URL_PARAMETERS))


URL_PARAMETERS = ("page", "ref", "utm_source", "absent")
URL_VALUES = ", ".join(f"CASE WHEN regexp_matches(q, '(^|&){n}=') THEN url_decode(replace(regexp_extract(q, '(?:^|&){n}=([^&]*)', 1), '+', ' ')) END AS {n}" for n in URL_PARAMETERS)
URL_SQL = rf"SELECT page_id, {URL_VALUES} FROM (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"


def expand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").withColumn("first", (F.col("doc_id") % 5 + 1).cast("int"))
    low, high = expand.clamped(F.lit(1), F.lit(999), F.col("first"), F.col("first") + 3)
    lines = expand.lines_of(rows, low, high, ("doc_id",))
    return lines.select("doc_id", "number", expand.numbered(F.col("number"), F.col("content")).alias("line"))


LINES_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, CAST(doc_id % 5 + 1 AS INT) AS a FROM documents),
e AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) AS number, a FROM t)
SELECT doc_id, CAST(number AS INT) AS number, lpad(CAST(number AS VARCHAR), 5, ' ') || ' | ' || content AS line FROM e WHERE number BETWEEN a AND a + 3
"""


def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    by_type = events.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    total = events.groupBy().agg(F.count(F.lit(1)).alias("value")).select(F.lit("queries").alias("key"), "value")
    fields = events.groupBy(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key")).agg(F.count(F.lit(1)).alias("value")).where("key is not null")
    return store.added_counters(by_type, total, by_type, fields)


COUNTER_SQL = """
WITH c AS (SELECT event_type AS key, 2 * count(*) AS value FROM events GROUP BY event_type
  UNION ALL SELECT 'queries', count(*) FROM events
  UNION ALL SELECT 'k' || json_extract_string(props, '$.k'), count(*) FROM events GROUP BY 1 HAVING json_extract_string(any_value(props), '$.k') IS NOT NULL)
SELECT key, CAST(sum(value) AS BIGINT) AS value FROM c WHERE key IS NOT NULL GROUP BY key
"""


def query_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("mean"))


QUERY_COUNTERS_SQL = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY event_type"


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as changes of files: type gives the kind, user the path."""
    kinds = F.array(*[F.lit(k) for k in maintain.KINDS])
    kind = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/repo/u"), F.col("user_id"), F.lit(".c"))
    old = F.when(kind == "renamed", F.concat(F.lit("/repo/u"), (F.col("user_id") + 1), F.lit(".c")))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), path.alias("path"), old.alias("old_path"))


CHANGES_SQL = """
WITH ch AS (SELECT event_id AS seq, list_value('created', 'modified', 'deleted', 'renamed')[CAST(event_id % 4 + 1 AS INT)] AS kind, '/repo/u' || user_id || '.c' AS path,
  CASE WHEN event_id % 4 = 3 THEN '/repo/u' || (user_id + 1) || '.c' END AS old_path FROM events),
steps AS (SELECT seq, path, kind = 'deleted' AS gone, 1 AS part FROM ch UNION ALL SELECT seq, old_path, true, 0 FROM ch WHERE kind = 'renamed')
"""


def last_event_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.last_changes(change_rows(spark, sf_dir))


LAST_SQL = CHANGES_SQL + "SELECT path, arg_max(gone, seq * 2 + part) AS gone, max(seq) AS seq FROM steps GROUP BY path"


def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    # of three events the first two are a pair, the third arrives from elsewhere
    third = F.col("event_id") % 3
    cookie = F.when(third == 2, -F.col("event_id")).otherwise(F.floor(F.col("event_id") / 3))
    raw = events.select(F.col("event_id").alias("seq"), cookie.cast("bigint").alias("cookie"), F.when(third == 0, "from").otherwise("to").alias("side"), F.concat(F.lit("/repo/u"), "user_id").alias("path"))
    return maintain.paired_moves(raw)


RENAME_SQL = """
WITH m AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 2 THEN -event_id ELSE event_id // 3 END AS cookie, CASE WHEN event_id % 3 = 0 THEN 'from' ELSE 'to' END AS side, '/repo/u' || user_id AS path FROM events)
SELECT t.seq, CASE WHEN f.seq IS NULL THEN 'created' ELSE 'renamed' END AS kind, t.path, f.path AS old_path
FROM m t LEFT JOIN m f ON f.cookie = t.cookie AND f.side = 'from' AND f.seq < t.seq WHERE t.side = 'to'
"""

QUERIES = {f.__name__: f for f in (tokenize_terms, intent_classify, path_functions, url_params, expand_lines, counter_merge, query_counters, last_event_per_path, rename_pairs)}
SQL = {
    "tokenize_terms": TERMS_SQL,
    "intent_classify": INTENT_SQL,
    "path_functions": PATHS_SQL,
    "url_params": URL_SQL,
    "expand_lines": LINES_SQL,
    "counter_merge": COUNTER_SQL,
    "query_counters": QUERY_COUNTERS_SQL,
    "last_event_per_path": LAST_SQL,
    "rename_pairs": RENAME_SQL,
}
