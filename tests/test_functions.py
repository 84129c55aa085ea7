from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import hashing, paths, symbols
from lodestrand.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_terms(spark):
    ask = lambda s: one(spark, T.terms(F.lit(s)))[0]
    assert ask("where is the API status endpoint implemented") == ["api", "statu", "endpoint", "implement"]
    assert ask("string bring indexing") == ["str", "bring", "index"]
    assert ask("") == [] and ask("___ the of") == ["___"]
    assert [len(t) for t in ask("x" * 133)] == [63, 5]
    assert ask("Kelvin kelvin") == ["elvin", "kelvin"]
    assert len(ask(" ".join(f"term{i}x" for i in range(40)))) == 24


def test_symbol_tokens(spark):
    got = one(spark, T.symbol_tokens(F.lit("app_live_beta"), F.lit("/p/live.c"), F.lit(""), F.lit("int app_live_beta(void) ")))[0]
    assert got == ["app", "live", "beta", "app_live_beta", "int"]
    assert one(spark, T.symbol_tokens(F.lit("fooBar"), F.lit("x"), F.lit("Sc"), F.lit("")))[0] == ["foo", "bar", "foobar", "sc"]


def test_fnv_is_the_bytewise_hash(spark):
    texts = ["", "a", "/a/b.c:name:12", "é漢🎉", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv64(F.col("t")).alias("h"), hashing.unsigned_text(hashing.fnv64(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.h % 2**64 == fnv(r.t.encode()) and r.u == str(fnv(r.t.encode()))


def test_unit_float(spark):
    def want(v):
        m = 2**64
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD % m
        v ^= v >> 33
        v = v * 0xC4CEB9FE1A85EC53 % m
        v ^= v >> 33
        return (v & 0xFFFFFF) / 16777215

    ids = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", hashing.unit_float(F.col("i")).alias("u")).collect():
        assert abs(r.u - want(r.i % 2**64)) < 1e-12


def test_paths(spark):
    show = lambda p, r: one(spark, paths.display(F.lit(p), F.lit(r)))[0]
    assert show("/repo/a.c", "/repo") == "a.c" and show("/repo2/a.c", "/repo") == "/repo2/a.c" and show("/repo", "/repo") == "."
    assert one(spark, paths.basename(F.lit("a.c")), paths.dirname(F.lit("a.c")), paths.dirname(F.lit("/x/a.c"))) == ("a.c", "", "/x")
    assert one(spark, paths.language(F.lit("/a/b.tsx")), paths.language(F.lit("Makefile")), paths.language(F.lit("a.C"))) == (4, 7, 7)
    assert one(spark, paths.in_skipped_dir(F.lit("a/build/b")), paths.in_skipped_dir(F.lit("a/builds")), paths.in_skipped_dir(F.lit("/x/.git"))) == (True, False, True)
    assert one(spark, *[paths.size_label(F.lit(n)) for n in (5, 2048, 3 * 1024 * 1024)]) == ("5B", "2.0K", "3.0M")
    assert one(spark, paths.url_parameter(F.lit("http://h/p?a=1&q=x+y%21#f"), "q"), paths.url_parameter(F.lit("http://h/p"), "q")) == ("x y!", None)


def test_intents_and_small_functions(spark):
    ask = lambda s: one(spark, T.intent(F.lit(s)))[0]
    assert [ask(s) for s in ("audit and fix", "Fix it", "why so", "call chain of x", "where", "zzz")] == ["review", "edit", "debug", "trace", "explain", "unknown"]
    assert one(spark, T.estimated_tokens(F.lit("x" * 400)))[0] == 101
    assert one(spark, T.rightmost_name(F.lit("a.b::c->d/e()")), T.one_line(F.lit("a\tb\nc"))) == ("e", "a b c")
    assert one(spark, symbols.kind_label(F.lit(10)), symbols.kind_list_label(F.lit(10)), symbols.edge_label(F.lit(9))) == ("node", "?", "calls")


def test_token_scores(spark):
    prefix = K.PUBLIC_PREFIXES[0]
    name = f"{prefix}live_beta"
    row = spark.createDataFrame([(name, "/p/live.c", "", f"int {name}(void) ", 0, 5, 7, True)], "name string, file string, scope string, signature string, kind int, line int, end_line int, is_definition boolean")
    got = row.select(*[symbols.token_score(F.lit(t), F.lit(0.15)) for t in (name, prefix.strip("_"), "live")]).first()
    assert [round(x, 2) for x in got] == [76.15, 58.15, 44.15]
