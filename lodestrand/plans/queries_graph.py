"""Queries over the virtual code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions import text as T
from lodestrand.functions.hashing import fnv64, symbol_id
from lodestrand.functions.paths import dirname, is_vendor
from lodestrand.operators import expand, index, listing, project, resolve, retrieve, store
from lodestrand.plans.virtual import GRAPH_SQL, Graph, virtual_graph

TASK = "fix the red supplier_000000007 almond"
NARROW = "where is supplier_000000007 implemented"
ANCHOR = "supplier_000000003 calls"
FILE = "/repo/supplier/n3.py"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query on the graph under its name, with what follows GRAPH_SQL in its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(virtual_graph(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = GRAPH_SQL + sql
        return f

    return add


def _terms_sql(text: str) -> str:
    from re import findall

    out = []
    for w in findall("([A-Za-z0-9_]{1,63})[A-Za-z0-9_]?", text):
        w = w.lower()
        w = w[:-3] if len(w) > 5 and w.endswith("ing") else w[:-2] if len(w) > 4 and w.endswith("ed") else w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w
        if len(w) >= 2 and w not in K.STOPWORDS and w not in out:
            out.append(w)
    return "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(out[: K.MOST_TERMS])) + ") v(pos, term)"


TOKENS_SQL = r""", parts AS (
  SELECT id, list_concat(string_split(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '_'),
                         [name, regexp_replace(base, '\.[^.]*$', ''), scope, regexp_extract(signature, '^([^ (]{2,31})[ (]', 1)]) AS ts
  FROM sym WHERE kind <> 10
), each AS (SELECT id, left(lower(unnest(ts)), 63) AS token, generate_subscripts(ts, 1) AS pos FROM parts
), firsts AS (SELECT id, token, min(pos) AS pos FROM each WHERE length(token) >= 2 GROUP BY id, token
), numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM firsts
), postings AS (
  SELECT token, id, CAST(CASE WHEN vendor THEN 0.3 ELSE 1.0 END AS DOUBLE) * (
    CASE WHEN lower(name) = token THEN 40.0 WHEN starts_with(lower(name), token) THEN 22.0 WHEN lower(base) = token THEN 10.0 ELSE 8.0 END
    + importance + hub + CASE WHEN is_definition THEN 6 ELSE 0 END + CASE WHEN public_entry THEN 14 ELSE 0 END + CASE WHEN prefixed THEN 6 ELSE 0 END) AS base_score
  FROM numbered JOIN sym USING (id) WHERE r <= 32
)
"""


def _seeds_sql(text: str) -> str:
    return TOKENS_SQL + f""", terms AS (SELECT * FROM {_terms_sql(text)}
), matched AS (
  SELECT id, pos, 0 AS is_prefix, base_score AS weight FROM postings JOIN terms ON token = term
  UNION ALL SELECT id, pos, 1, CAST(0.5 AS DOUBLE) * base_score FROM postings JOIN terms ON length(term) >= 4 AND starts_with(token, term) AND token <> term
), scored AS (SELECT id, sum(weight) + 8 * (sum(1 - is_prefix) + min(2 * pos + is_prefix) % 2) AS score FROM matched GROUP BY id
), seeds AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM scored WHERE score >= 6 ORDER BY score DESC, id LIMIT {K.MOST_SEEDS}))
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


FNV_SQL = """
, bytes AS (SELECT id, file || ':' || name || ':' || line AS s FROM v_symbols
), hashed AS (SELECT id, list_reduce(list_concat([14695981039346656037::HUGEINT],
    [ord(c)::HUGEINT FOR c IN string_split(s, '')]),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM bytes)
SELECT id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS symbol_id FROM hashed
"""


@query(FNV_SQL)
def fnv_symbol_id(g: Graph) -> DataFrame:
    return g.symbols.select("id", symbol_id(F.col("file"), F.col("name"), F.col("line")).alias("symbol_id"))


@query("SELECT id, vendor, static_marked, prefixed, public_entry, label, CAST(importance AS INT) AS importance FROM sym")
def public_entrypoints(g: Graph) -> DataFrame:
    c = F.col
    return g.symbols.select("id", is_vendor(c("file")).alias("vendor"), S.has_static_marker(c("signature")).alias("static_marked"), S.has_public_prefix(c("name")).alias("prefixed"), S.is_public_entrypoint().alias("public_entry"), S.kind_label(c("kind")).alias("label"), S.kind_importance(c("kind")).alias("importance"))


@query(TOKENS_SQL + "SELECT id, token FROM numbered WHERE r <= 32")
def symbol_tokens(g: Graph) -> DataFrame:
    c = F.col
    return g.symbols.where(c("kind") != K.UNKNOWN).select("id", F.explode(T.symbol_tokens(c("name"), c("file"), c("scope"), c("signature"))).alias("token"))


@query(TOKENS_SQL + "SELECT token, id, round(base_score, 6) AS score FROM postings")
def postings(g: Graph) -> DataFrame:
    return _rounded(index.postings(g.symbols, g.edges).withColumnRenamed("base_score", "score"))


@query("SELECT id, other_id, kind, outgoing, seq FROM adj")
def adjacency(g: Graph) -> DataFrame:
    return index.adjacency(g.edges).select("id", "other_id", "kind", "outgoing", "seq")


@query("SELECT id, CAST(degree AS BIGINT) AS degree, CAST(least(12.0, degree * 0.15) AS DOUBLE) AS hub FROM deg")
def degree_hub(g: Graph) -> DataFrame:
    return index.degrees(g.edges).select("id", "degree", S.hub_bonus(F.col("degree")).alias("hub"))


@query(_seeds_sql(TASK) + "SELECT id, CAST(pos AS INT) AS pos, CAST(is_prefix AS INT) AS is_prefix, round(weight, 6) AS weight FROM matched")
def seed_matches(g: Graph) -> DataFrame:
    found = index.matches(index.postings(g.symbols, g.edges), index.terms_table(g.symbols, TASK))
    return found.withColumn("weight", F.round("weight", 6))


@query(_seeds_sql(TASK) + "SELECT id, round(score, 6) AS score FROM scored WHERE score >= 6")
def seed_scores(g: Graph) -> DataFrame:
    return _rounded(index.scores(index.matches(index.postings(g.symbols, g.edges), index.terms_table(g.symbols, TASK))))


@query(_seeds_sql(TASK) + "SELECT id, round(score, 6) AS score FROM seeds")
def seed_topk(g: Graph) -> DataFrame:
    return _rounded(index.task_seeds(g.symbols, g.edges, TASK))


ANCHOR_NAME = ANCHOR.split()[0]
ANCHOR_SQL = f""", terms AS (SELECT * FROM {_terms_sql(ANCHOR)}
), hits AS (SELECT s.id, CASE WHEN lower(name) = term THEN 40 WHEN contains(lower(name), term) THEN 18 ELSE 0 END + CASE WHEN contains(lower(base), term) THEN 10 ELSE 0 END
    + CASE WHEN contains(lower(file), term) THEN 6 ELSE 0 END + CASE WHEN contains(lower(signature), term) THEN 5 ELSE 0 END + CASE WHEN contains(lower(scope), term) THEN 4 ELSE 0 END AS points
  FROM sym s, terms WHERE kind <> 10
), fields AS (SELECT id, sum(points) AS points, count(*) AS covered FROM hits WHERE points > 0 GROUP BY id
), anchored AS (SELECT s.id, CASE WHEN lower(name) = '{ANCHOR_NAME}' THEN 200.0 + importance WHEN contains(lower(name), '{ANCHOR_NAME}') THEN 100.0 + importance
    WHEN f.id IS NULL THEN 0.0 ELSE CAST(CASE WHEN vendor THEN 0.3 ELSE 1.0 END AS DOUBLE) * (points + 8 * covered + importance + CASE WHEN is_definition THEN 6 ELSE 0 END
      + CASE WHEN public_entry THEN 14 ELSE 0 END + CASE WHEN prefixed THEN 6 ELSE 0 END + CASE WHEN scope <> '' THEN 2 ELSE 0 END) END AS score
  FROM sym s LEFT JOIN fields f ON f.id = s.id)
SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM anchored WHERE score >= 6
"""


@query(ANCHOR_SQL)
def anchor_symbol_scores(g: Graph) -> DataFrame:
    return _rounded(index.symbol_anchor_scores(g.symbols, ANCHOR))


@query(f"SELECT id, CAST(200.0 + importance AS DOUBLE) AS score FROM sym WHERE file = '{FILE}'")
def anchor_file(g: Graph) -> DataFrame:
    return index.file_anchor_scores(g.symbols, FILE)


RESOLVE_SQL = """
, cand AS (SELECT name, id, file, module, CASE WHEN is_definition THEN 20 ELSE 0 END + list_value(5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 0)[kind + 1] AS worth FROM sym
), pend AS (SELECT *, regexp_replace(caller_file, '/[^/]*$', '') AS caller_module FROM v_pending
), t_all AS (SELECT p.seq, c.id, CASE WHEN c.file = p.caller_file THEN 100 WHEN c.module = p.caller_module THEN 40 ELSE 0 END + worth AS score FROM pend p JOIN cand c ON c.name = p.callee_name
), t_best AS (SELECT seq, id AS target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS r FROM t_all) WHERE r = 1
), s_all AS (SELECT p.seq, c.id, CASE WHEN c.file = p.caller_file THEN 100 WHEN c.module = p.caller_module THEN 40 ELSE 0 END + worth AS score FROM pend p JOIN cand c ON c.name = p.caller_name
), s_best AS (SELECT seq, id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS r FROM s_all) WHERE r = 1
)
"""


@query(RESOLVE_SQL + "SELECT seq, target_id, CAST(score AS INT) AS score FROM t_best")
def resolve_targets(g: Graph) -> DataFrame:
    return resolve.resolved_targets(g.pending, g.symbols)


RESOLVED_EDGES_SQL = RESOLVE_SQL + """
, site AS (SELECT p.*, t.target_id, s.source_id, caller_file || ':' || coalesce(caller_name, callee_name) || ':' || caller_line AS s FROM pend p JOIN t_best t USING (seq) LEFT JOIN s_best s USING (seq)
), hashed AS (SELECT *, list_reduce(list_concat([14695981039346656037::HUGEINT], [ord(c)::HUGEINT FOR c IN string_split(s, '')]),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM site
), found AS (SELECT coalesce(source_id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT)) AS from_id, target_id AS to_id, kind, seq FROM hashed)
SELECT from_id, to_id, kind, min(seq) AS seq FROM found WHERE from_id <> to_id GROUP BY from_id, to_id, kind
"""


@query(RESOLVED_EDGES_SQL)
def resolve_edges(g: Graph) -> DataFrame:
    return resolve.resolved_edges(g.pending, g.symbols)


@query(RESOLVE_SQL + "SELECT count(*) AS pending, count(target_id) AS found, count(*) - count(target_id) AS missed FROM pend LEFT JOIN t_best USING (seq)")
def resolve_stats(g: Graph) -> DataFrame:
    return resolve.resolution_counts(g.pending, g.symbols)


WALK_SQL = """
, ways AS (SELECT a.id, a.other_id, a.kind, a.outgoing, a.seq, o.vendor AS into_vendor FROM adj a JOIN sym o ON o.id = a.other_id WHERE o.kind <> 10 AND NOT (a.kind = 3 AND NOT a.outgoing)
), walk AS (
  SELECT CAST(0 AS INT) AS level, s.id AS start_id, s.id, s.vendor AS from_vendor FROM sym s WHERE s.id IN (10000001, 10000002)
  UNION
  SELECT w.level + 1, w.start_id, x.other_id, w.from_vendor FROM walk w JOIN ways x ON x.id = w.id WHERE w.level < 2 AND NOT (x.kind = 3 AND NOT w.from_vendor AND x.into_vendor)
)
SELECT start_id, id, CAST(min(level) AS INT) AS level FROM walk WHERE id <> start_id GROUP BY start_id, id
"""


@query(WALK_SQL)
def bfs_levels(g: Graph) -> DataFrame:
    starts = g.symbols.where(F.col("id").isin(10000001, 10000002)).select(F.col("id").alias("rank"), "id")
    found = retrieve.levels(starts, g.symbols, g.edges, depth=2, budget=10**6)
    return found.where("id <> rank").groupBy(F.col("rank").alias("start_id"), "id").agg(F.min("level").alias("level"))


STARTS_SQL = ", starts AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM sym WHERE id % 400 = 1 OR id BETWEEN 10000001 AND 10000008)\n"


def _starts(g: Graph) -> DataFrame:
    from pyspark.sql import Window

    rows = g.symbols.where("id % 400 = 1 or id between 10000001 and 10000008")
    return rows.select("id", F.row_number().over(Window.orderBy("id")).cast("bigint").alias("rank"))


@query(STARTS_SQL + """
, mates AS (SELECT min(rank) AS rank, m.id, m.public_entry AS is_public, m.seq FROM starts s JOIN sym h ON h.id = s.id JOIN sym m ON m.file = h.file AND m.id <> s.id WHERE m.kind <> 10 GROUP BY m.id, m.public_entry, m.seq
), placed AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY is_public DESC, seq, id) AS place FROM mates)
SELECT rank, id, is_public, CAST(place AS INT) AS place FROM placed WHERE place <= 8
""")
def siblings(g: Graph) -> DataFrame:
    return retrieve.siblings(_starts(g), g.symbols)


@query("""
, starts AS (SELECT id, id AS rank FROM sym
), files AS (SELECT DISTINCT s.rank, t.file FROM starts s JOIN v_edges e ON e.from_id = s.id AND e.kind = 1 JOIN sym t ON t.id = e.to_id WHERE t.kind <> 10 AND NOT t.vendor)
SELECT DISTINCT rank, m.id FROM files f JOIN sym m ON m.file = f.file WHERE m.kind <> 10
""")
def include_chain(g: Graph) -> DataFrame:
    starts = g.symbols.select("id", F.col("id").alias("rank"))
    return retrieve.include_chain(starts, g.symbols, g.edges)


@query("SELECT place, id, seq FROM (SELECT *, dense_rank() OVER (ORDER BY file) AS place FROM sym WHERE file LIKE '/repo/supplier/%') WHERE public_entry")
def file_entrypoints(g: Graph) -> DataFrame:
    from pyspark.sql import Window

    files = g.symbols.where(F.col("file").like("/repo/supplier/%")).select("file").distinct()
    files = files.withColumn("place", F.row_number().over(Window.orderBy("file")).cast("bigint"))
    return retrieve.file_entrypoints(files, g.symbols)


@query("""
, every AS (SELECT file, module, base, vendor, min(seq) AS seq FROM sym WHERE kind <> 10 GROUP BY file, module, base, vendor
), pairs AS (SELECT a.file, b.base AS peer, min(b.seq) AS seq FROM (SELECT DISTINCT file, module FROM sym) a JOIN every b ON b.module = a.module AND b.file <> a.file WHERE NOT b.vendor GROUP BY a.file, b.base)
SELECT file, peer, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq, peer) AS place FROM pairs) WHERE place <= 8
""")
def dir_peers(g: Graph) -> DataFrame:
    return retrieve.dir_peers(g.symbols.select("file").distinct(), g.symbols)


COLLECTED_SQL = _seeds_sql(NARROW) + f"""
, ways AS (SELECT a.id, a.other_id, a.kind, a.outgoing, a.seq, o.vendor AS into_vendor FROM adj a JOIN sym o ON o.id = a.other_id WHERE o.kind <> 10 AND NOT (a.kind = 3 AND NOT a.outgoing)
), l0 AS (SELECT rank, s.id, y.vendor AS from_vendor, CAST(0 AS BIGINT) AS parent FROM seeds s JOIN sym y USING (id)
), a1 AS (SELECT rank, 1 AS level, other_id AS id, outgoing, [1, parent, -seq, other_id] AS place, from_vendor FROM l0 JOIN ways w ON w.id = l0.id WHERE NOT (kind = 3 AND NOT from_vendor AND into_vendor)
), l1 AS (SELECT rank, id, from_vendor, row_number() OVER (PARTITION BY rank ORDER BY place) AS parent FROM (SELECT rank, id, any_value(from_vendor) AS from_vendor, min(place) AS place FROM a1 GROUP BY rank, id) x
    WHERE NOT EXISTS (SELECT 1 FROM l0 WHERE l0.rank = x.rank AND l0.id = x.id) QUALIFY parent <= 128
), a2 AS (SELECT rank, 2 AS level, other_id AS id, outgoing, [2, parent, -seq, other_id] AS place, from_vendor FROM l1 JOIN ways w ON w.id = l1.id WHERE NOT (kind = 3 AND NOT from_vendor AND into_vendor)
), v1 AS (SELECT rank, id FROM l0 UNION SELECT rank, id FROM l1
), l2 AS (SELECT rank, id, from_vendor, row_number() OVER (PARTITION BY rank ORDER BY place) AS parent FROM (SELECT rank, id, any_value(from_vendor) AS from_vendor, min(place) AS place FROM a2 GROUP BY rank, id) x
    WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.rank = x.rank AND v1.id = x.id) QUALIFY parent <= 128
), a3 AS (SELECT rank, 3 AS level, other_id AS id, outgoing, [3, parent, -seq, other_id] AS place, from_vendor FROM l2 JOIN ways w ON w.id = l2.id WHERE NOT (kind = 3 AND NOT from_vendor AND into_vendor)
), v2 AS (SELECT rank, id FROM v1 UNION SELECT rank, id FROM l2
), l3 AS (SELECT rank, id, from_vendor, row_number() OVER (PARTITION BY rank ORDER BY place) AS parent FROM (SELECT rank, id, any_value(from_vendor) AS from_vendor, min(place) AS place FROM a3 GROUP BY rank, id) x
    WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v2.rank = x.rank AND v2.id = x.id) QUALIFY parent <= 128
), a4 AS (SELECT rank, 4 AS level, other_id AS id, outgoing, [4, parent, -seq, other_id] AS place, from_vendor FROM l3 JOIN ways w ON w.id = l3.id WHERE NOT (kind = 3 AND NOT from_vendor AND into_vendor)
), walked AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4
), st12 AS (SELECT id, 1 AS stage, [rank] AS place, score, 'query match' AS reason FROM seeds
    UNION ALL SELECT id, 2, min(list_concat([rank], place)), CAST(60.0 - 10 * level AS DOUBLE), CASE WHEN outgoing THEN 'callee' ELSE 'caller' END FROM walked GROUP BY id, level, outgoing
), mates AS (SELECT min(rank) AS rank, m.id, m.public_entry AS is_public, m.seq FROM seeds s JOIN sym h ON h.id = s.id JOIN sym m ON m.file = h.file AND m.id <> s.id
    WHERE m.kind <> 10 AND rank <= {K.SEED_SPREAD} AND m.id NOT IN (SELECT id FROM st12) GROUP BY m.id, m.public_entry, m.seq
), st3 AS (SELECT id, 3 AS stage, [rank, place] AS place, CASE WHEN is_public THEN 45.0 ELSE 20.0 END AS score, CASE WHEN is_public THEN 'co-file entrypoint' ELSE 'co-file' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY is_public DESC, seq, id) AS place FROM mates) WHERE place <= 8
), inc AS (SELECT DISTINCT s.rank, t.file FROM seeds s JOIN v_edges e ON e.from_id = s.id AND e.kind = 1 JOIN sym t ON t.id = e.to_id WHERE t.kind <> 10 AND NOT t.vendor AND s.rank <= {K.SEED_SPREAD}
), st4 AS (SELECT DISTINCT m.id, 4 AS stage, [rank, m.id] AS place, 15.0 AS score, 'include-chain' AS reason FROM inc f JOIN sym m ON m.file = f.file WHERE m.kind <> 10
), st14 AS (SELECT * FROM st12 UNION ALL SELECT * FROM st3 UNION ALL SELECT * FROM st4
), first14 AS (SELECT id, min(list_concat([stage], place)) AS f FROM st14 GROUP BY id ORDER BY f, id LIMIT {K.MOST_SET}
), ffiles AS (SELECT file, row_number() OVER (ORDER BY min(f), file) AS place FROM first14 JOIN sym USING (id) GROUP BY file QUALIFY place <= {K.ENTRYPOINT_FILES}
), stages AS (SELECT * FROM st14 UNION ALL SELECT m.id, 5, [place, m.seq, 0], 46.0, 'file entrypoint' FROM ffiles JOIN sym m USING (file) WHERE m.public_entry
), kept AS (SELECT id, min(list_concat([stage], place)) AS f FROM stages GROUP BY id ORDER BY f, id LIMIT {K.MOST_SET}
), best AS (SELECT id, score, reason, row_number() OVER (PARTITION BY id ORDER BY score DESC, stage, place) AS r FROM stages JOIN kept USING (id))
SELECT id, round(CAST(score AS DOUBLE), 6) AS score, reason FROM best WHERE r = 1
"""


@query(COLLECTED_SQL)
def retrieve_task_set(g: Graph) -> DataFrame:
    symbols, edges = g.symbols.persist(), g.edges.persist()  # a stored graph would be read, this one is derived
    return _rounded(retrieve.collected(symbols, edges, index.task_seeds(symbols, edges, NARROW)))


def _ids(g: Graph) -> DataFrame:
    return g.symbols.select("id")


NEAR_SQL = ", near AS (SELECT a.*, o.name AS other_name, o.file AS other_file, o.base AS other_base, o.line AS other_line FROM adj a JOIN sym o ON o.id = a.other_id WHERE o.kind <> 10)\n"


@query(NEAR_SQL + """
, placed AS (SELECT *, (kind = 3 AND NOT outgoing) AS hidden, row_number() OVER (PARTITION BY id ORDER BY (kind = 3 AND NOT outgoing), seq, other_id, outgoing, kind) AS place, count(*) OVER (PARTITION BY id) AS total FROM near WHERE id IN (SELECT id FROM v_symbols)
), shown AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM placed WHERE NOT hidden AND place <= 4)
SELECT id, CAST(place AS INT) AS place, outgoing, kind, other_name, other_base, other_line, total > n AS more FROM shown
""")
def card_relations(g: Graph) -> DataFrame:
    return retrieve.card_relations(_ids(g), g.edges, g.symbols)


@query(NEAR_SQL + """
, grouped AS (SELECT n.*, s.file AS own_file, CASE WHEN n.kind = 0 AND outgoing THEN 'calls' WHEN n.kind = 0 THEN 'called-by' WHEN n.kind = 1 AND outgoing THEN 'includes' WHEN n.kind = 1 THEN 'included-by'
    WHEN n.kind = 2 THEN 'defines' WHEN n.kind = 3 AND outgoing THEN 'refs' WHEN n.kind = 4 THEN 'inherits' END AS edge_group FROM near n JOIN v_symbols s ON s.id = n.id
), placed AS (SELECT *, row_number() OVER (PARTITION BY id, edge_group ORDER BY seq, other_id, outgoing) AS place FROM grouped WHERE edge_group IS NOT NULL)
SELECT id, edge_group, string_agg(other_name || CASE WHEN other_file = own_file THEN ':' || other_line ELSE '(' || other_base || ':' || other_line || ')' END, ', ' ORDER BY place) AS names
FROM placed WHERE place <= 6 GROUP BY id, edge_group
""")
def edge_groups(g: Graph) -> DataFrame:
    return retrieve.edge_groups(_ids(g), g.edges, g.symbols)


@query(f""", terms AS (SELECT * FROM {_terms_sql(NARROW)}
), hit AS (SELECT s.file, s.name, s.seq, s.id, bool_or(contains(lower(s.name), term) OR contains(lower(s.signature), term)) AS hit FROM sym s, terms WHERE s.public_entry GROUP BY s.file, s.name, s.seq, s.id
), placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY hit DESC, seq, id) AS place FROM hit)
SELECT file, string_agg(name, ',' ORDER BY place) AS hints FROM placed WHERE place <= 3 GROUP BY file
""")
def entrypoint_hints(g: Graph) -> DataFrame:
    return retrieve.entrypoint_hints(g.symbols.select("file").distinct(), g.symbols, T.terms(F.lit(NARROW)))


RANKED_SQL = ", found AS (SELECT id, file, module, lang, id AS rank FROM sym)\n"


def _found(g: Graph) -> DataFrame:
    return g.symbols.select("id", "file", "lang", F.col("id").alias("rank"))


@query(RANKED_SQL + "SELECT module, count(*) AS n_symbols, arg_min(lang, rank) AS lang, min(rank) AS first FROM found GROUP BY module ORDER BY first LIMIT 64")
def module_rollup(g: Graph) -> DataFrame:
    return retrieve.modules_of(_found(g))


@query(RANKED_SQL + """
, files AS (SELECT module, file, count(*) AS n_symbols, arg_min(lang, rank) AS lang, min(rank) AS first FROM found GROUP BY module, file
), firsts AS (SELECT *, min(first) OVER (PARTITION BY module) AS module_first FROM files)
SELECT module, file, n_symbols, lang, CAST(dense_rank() OVER (ORDER BY module_first) AS INT) AS module_place, CAST(row_number() OVER (PARTITION BY module ORDER BY first) AS INT) AS file_place FROM firsts
""")
def file_rollup(g: Graph) -> DataFrame:
    return retrieve.files_of(_found(g))


@query(f"""
, rows_ AS (SELECT *, row_number() OVER (PARTITION BY public_entry ORDER BY seq) AS n FROM sym WHERE file = '{FILE}' AND kind NOT IN (8, 10)
), cut AS (SELECT *, CASE WHEN n > CASE WHEN public_entry THEN 24 ELSE 32 END THEN 'omitted' WHEN public_entry THEN 'entrypoint' ELSE 'internal' END AS section FROM rows_
), placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY seq) AS place FROM cut)
SELECT section, CAST(place AS INT) AS place, id, name, line FROM placed WHERE section <> 'omitted' OR place <= 24
""")
def expand_file(g: Graph) -> DataFrame:
    return expand.file_map(g.symbols, FILE).select("section", "place", "id", "name", "line")


@query(f"""
, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE public_entry) AS entrypoints FROM sym WHERE file = '{FILE}' AND kind NOT IN (8, 10))
SELECT total, entrypoints, total - entrypoints AS internals, least(entrypoints, 24) + least(total - entrypoints, 32) AS listed, total - least(entrypoints, 24) - least(total - entrypoints, 32) AS omitted FROM c
""")
def expand_file_totals(g: Graph) -> DataFrame:
    return expand.file_totals(g.symbols, FILE)


@query(f"SELECT id, name, line FROM sym WHERE file = '{FILE}' AND public_entry ORDER BY seq LIMIT 24")
def expand_entrypoints(g: Graph) -> DataFrame:
    return expand.entrypoints(g.symbols, FILE).select("id", "name", "line")


def _relation(name: str, id: int, kind: int, direction: int) -> None:
    side = {1: "AND outgoing", -1: "AND NOT outgoing", 0: ""}[direction]
    QUERIES[name] = lambda spark, sf_dir: expand.related(*(lambda g: (g.symbols, g.edges))(virtual_graph(spark, sf_dir)), id, kind, direction)
    SQL[name] = GRAPH_SQL + f"SELECT other_id, o.kind AS other_kind, o.name AS other_name, o.file AS other_file, o.line AS other_line, outgoing, a.seq FROM adj a JOIN sym o ON o.id = a.other_id WHERE a.id = {id} AND a.kind = {kind} AND o.kind <> 10 {side}"


_relation("expand_callers", 10000005, K.CALLS, -1)
_relation("expand_callees", 51, K.CALLS, 1)
_relation("expand_refs", 10000005, K.REFERENCES, 0)


@query("SELECT a.other_id, a.kind, a.outgoing, a.seq FROM adj a JOIN sym o ON o.id = a.other_id WHERE a.id = 10000005 AND o.kind <> 10 ORDER BY a.seq, a.other_id, a.kind, a.outgoing LIMIT 256")
def all_relations(g: Graph) -> DataFrame:
    return expand.all_relations(g.symbols, g.edges, 10000005).select("other_id", "kind", "outgoing", "seq")


LIST_LABEL = "list_value('fn', 'method', 'class', 'struct', 'enum', 'typedef', 'var', 'macro', 'include', 'ns', '?')[kind + 1]"


@query(f"""
SELECT seq, id, {LIST_LABEL} AS kind, name, base AS file, line, CASE WHEN scope = '' THEN '-' ELSE scope END AS scope FROM sym
WHERE is_definition AND (contains(lower(name), 'blue') OR contains(lower(file), 'blue') OR contains(lower(scope), 'blue') OR contains(lower(signature), 'blue') OR contains(lower({LIST_LABEL}), 'blue'))
ORDER BY seq LIMIT 80
""")
def list_symbols(g: Graph) -> DataFrame:
    return listing.symbol_rows(g.symbols, "blue").orderBy("seq").limit(K.PAGE_SIZE)


@query("""
SELECT e.seq, e.from_id, e.to_id, coalesce(f.name, '?') AS from_name, coalesce(t.name, '?') AS to_name, 'calls' AS kind, coalesce(f.base, '') AS from_file, coalesce(f.line, 0) AS from_line
FROM v_edges e LEFT JOIN sym f ON f.id = e.from_id LEFT JOIN sym t ON t.id = e.to_id
WHERE e.kind = 0 AND (contains(lower(coalesce(f.name, '?')), 'n3.py') OR contains(lower(coalesce(f.file, '')), 'n3.py') OR contains(lower(coalesce(t.name, '?')), 'n3.py') OR contains(lower(coalesce(t.file, '')), 'n3.py'))
ORDER BY e.seq, e.from_id, e.to_id LIMIT 80
""")
def list_calls(g: Graph) -> DataFrame:
    return listing.call_rows(g.symbols, g.edges, "n3.py").orderBy("seq", "from_id", "to_id").limit(K.PAGE_SIZE)


SIZE_SQL = "CASE WHEN size >= 1048576 THEN printf('%.1fM', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1fK', size / 1024.0) ELSE size || 'B' END"


@query(f"""
, n AS (SELECT file AS path, count(*) AS n_symbols FROM v_symbols WHERE is_definition GROUP BY file)
SELECT path, regexp_replace(path, '^.*/', '') AS name, list_value('C', 'C++', 'Py', 'JS', 'TS', 'Go', 'Rust', '?')[lang + 1] AS lang, coalesce(n_symbols, 0) AS n_symbols, {SIZE_SQL} AS size, '-' AS errors, regexp_replace(path, '/[^/]*$', '') AS dir
FROM v_files LEFT JOIN n USING (path) ORDER BY path LIMIT 80 OFFSET 80
""")
def list_files(g: Graph) -> DataFrame:
    return listing.file_rows(g.files, g.symbols).orderBy("path").offset(K.PAGE_SIZE).limit(K.PAGE_SIZE)


def _scanned(g: Graph) -> DataFrame:
    changed = (F.length("path") % 5 == 0).cast("int")
    return g.files.where(F.length("path") % 7 != 0).withColumn("mtime", F.col("mtime") + changed)


def _stored(g: Graph) -> DataFrame:
    return g.files.where(F.length("path") % 11 != 0)


STORED_SQL = ", scanned AS (SELECT path, mtime + CASE WHEN length(path) % 5 = 0 THEN 1 ELSE 0 END AS mtime FROM v_files WHERE length(path) % 7 <> 0), stored AS (SELECT * FROM v_files WHERE length(path) % 11 <> 0)\n"


@query(STORED_SQL + "SELECT s.path, s.mtime FROM scanned s LEFT JOIN stored o USING (path) WHERE o.mtime IS NULL OR o.mtime <> s.mtime")
def stale_files(g: Graph) -> DataFrame:
    return store.stale_files(_scanned(g), _stored(g)).select("path", "mtime")


@query(STORED_SQL + "SELECT path, mtime FROM stored WHERE path NOT IN (SELECT path FROM scanned)")
def deleted_files(g: Graph) -> DataFrame:
    return store.deleted_files(_scanned(g), _stored(g)).select("path", "mtime")


@query("""
, gone AS (SELECT DISTINCT file FROM v_symbols WHERE length(file) % 3 = 0), ids AS (SELECT id FROM v_symbols JOIN gone USING (file))
SELECT from_id, to_id, kind, seq FROM v_edges WHERE from_id NOT IN (SELECT id FROM ids) AND to_id NOT IN (SELECT id FROM ids)
""")
def cascade_delete(g: Graph) -> DataFrame:
    gone = g.files.where(F.length("path") % 3 == 0).select("path")
    return store.without_files(g.symbols, g.edges, gone)[1]


def _changed(g: Graph) -> DataFrame:
    return g.symbols.where("id % 3 = 0").withColumn("line", F.col("line") + 1).withColumn("seq", F.col("seq") + 50000000)


@query("""
, every AS (SELECT id, name, line, seq FROM v_symbols UNION ALL SELECT id, name, line + 1, seq + 50000000 FROM v_symbols WHERE id % 3 = 0)
SELECT id, arg_max(name, seq) AS name, arg_max(line, seq) AS line, min(seq) AS seq FROM every GROUP BY id
""")
def upsert_symbols(g: Graph) -> DataFrame:
    return store.upserted(g.symbols, _changed(g)).select("id", "name", "line", "seq")


NODES_SQL = """
, w AS (SELECT s.*, coalesce(degree, 0) AS degree FROM v_symbols s LEFT JOIN deg USING (id)
), cnt AS (SELECT count(*) FILTER (WHERE degree > 0) AS connected FROM w
), nodes AS (SELECT id, kind, file, CAST(degree AS BIGINT) AS degree, CAST(CASE WHEN degree > 0 THEN 180 ELSE 0 END + CASE WHEN is_definition THEN 40 ELSE 0 END
    + CASE WHEN kind IN (0, 1) THEN 120 WHEN kind IN (2, 3) THEN 110 WHEN kind IN (4, 5, 9) THEN 85 WHEN kind = 7 THEN 70 ELSE 12 END + degree * 24 AS BIGINT) AS weight
  FROM w, cnt WHERE degree > 0 OR (connected <= 100 AND kind <> 10) ORDER BY weight DESC, degree DESC, id LIMIT 1200
)
"""


@query(NODES_SQL + "SELECT id, kind, degree, weight, round(greatest(4.0, least(12.0, 3.5 + sqrt(degree + 1) * 0.6)), 6) AS radius FROM nodes")
def project_nodes(g: Graph) -> DataFrame:
    return project.project_nodes(g.symbols, g.edges).select("id", "kind", "degree", "weight", F.round("radius", 6).alias("radius"))


@query(NODES_SQL + "SELECT from_id, to_id, kind, seq FROM v_edges WHERE from_id <> to_id AND from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) ORDER BY seq, from_id, to_id, kind LIMIT 6000")
def project_edges(g: Graph) -> DataFrame:
    return project.project_edges(g.edges, project.project_nodes(g.symbols, g.edges))


@query(NODES_SQL + """
, placed AS (SELECT id, id % 100 AS x, id % 77 AS y, regexp_replace(file, '/[^/]*$', '') AS m FROM nodes)
SELECT m, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM placed GROUP BY m
""")
def module_centroids(g: Graph) -> DataFrame:
    nodes = project.project_nodes(g.symbols, g.edges).select(dirname(F.col("file")).alias("module_colour"), (F.col("id") % 100).alias("x"), (F.col("id") % 77).alias("y"))
    out = project.module_centroids(nodes)
    return out.select(F.col("module_colour").alias("m"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query()
def force_step(g: Graph) -> DataFrame:
    nodes = project.placed(project.project_nodes(g.symbols, g.edges, 200))
    return project.force_steps(nodes, project.project_edges(g.edges, nodes))


COLOURS_SQL = """
, hashed AS (SELECT path, list_reduce(list_concat([14695981039346656037::HUGEINT], [ord(c)::HUGEINT FOR c IN string_split(regexp_replace(path, '/[^/]*$', ''), '')]),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM v_files)
SELECT path, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash, CAST(h % 10 AS INT) AS colour FROM hashed
"""


@query(COLOURS_SQL)
def module_colours(g: Graph) -> DataFrame:
    hashed = g.files.select("path", fnv64(dirname(F.col("path"))).alias("hash"))
    return hashed.withColumn("colour", project.colour(F.col("hash")))


@query("""SELECT (SELECT count(*) FROM v_symbols) AS symbols, (SELECT count(*) FROM v_edges) AS edges, (SELECT count(*) FROM v_files) AS files""")
def graph_counts(g: Graph) -> DataFrame:
    count = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias(name))
    return count(g.symbols, "symbols").crossJoin(count(g.edges, "edges")).crossJoin(count(g.files, "files"))
