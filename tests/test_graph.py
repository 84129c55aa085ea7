import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import index, listing, project, resolve, retrieve, store
from lodestrand.plans import cases
from lodestrand.plans.engine import Engine, parse_id, parse_lines
from lodestrand.plans.virtual import Graph, virtual_graph
from lodestrand.sources.extract import extract_files, extract_text
from lodestrand.streaming import maintain

LIVE_2 = "int app_live_alpha(void) {\n    return 1;\n}\n\nint app_live_beta(void) {\n    return app_live_alpha() + 1;\n}\n"
LIVE_3 = "int app_live_alpha(void) {\n    return 42;\n}\n"


def symbol(id, name, file, line=1, kind=0, end=3, signature="int f(void) ", scope="", lang=0, definition=True):
    return (id, name, file, line, 1, end, kind, signature, scope, lang, definition, id)


def graph(spark, symbols, edges=()):
    return Graph(spark.createDataFrame(symbols, store.SYMBOLS), spark.createDataFrame(list(edges), store.EDGES))


def test_prefix_and_exact_hits(spark):
    rows = spark.createDataFrame([(7, 0, 1, 1.0), (7, 1, 0, 1.0), (8, 0, 0, 1.0), (8, 1, 1, 1.0)], "id bigint, pos int, is_prefix int, weight double")
    assert {r.id: r.score for r in index.scores(rows).collect()} == {7: 18.0, 8: 10.0}


def test_resolution_prefers_the_same_file_and_the_smallest_unsigned_id(spark):
    rows = [symbol(1, "f", "/a/x.c", definition=False), symbol(2, "f", "/a/y.c"), symbol(-5, "g", "/b/z.c"), symbol(6, "g", "/b/w.c"), symbol(9, "me", "/a/x.c")]
    pending = spark.createDataFrame([("/a/x.c", "me", "f", 3, 0, 1), ("/q/x.c", "me", "g", 3, 0, 2), ("/a/x.c", None, "f", 4, 0, 3), ("/a/x.c", "f", "f", 4, 0, 4), ("/a/x.c", "me", "none", 4, 0, 5)], store.PENDING)
    g = graph(spark, rows)
    assert {r.seq: r.target_id for r in resolve.resolved_targets(pending, g.symbols).collect()} == {1: 1, 2: 6, 3: 1, 4: 1}
    edges = resolve.resolved_edges(pending, g.symbols).collect()
    assert {(r.from_id, r.to_id) for r in edges if r.seq != 3} == {(9, 1), (9, 6)}
    assert len(edges) == 3
    assert tuple(resolve.resolution_counts(pending, g.symbols).first()) == (5, 4, 1)


def brute_levels(symbols, edges, start, depth):
    kind, file = {s[0]: s[6] for s in symbols}, {s[0]: s[2] for s in symbols}
    near = {}
    for f, t, k, _ in edges:
        near.setdefault(f, []).append((t, k, True))
        near.setdefault(t, []).append((f, k, False))
    seen, layer = {start: 0}, [start]
    for d in range(1, depth + 1):
        fresh = []
        for at in layer:
            for other, k, out in near.get(at, []):
                if other not in kind or kind[other] == 10 or k == 3 and (not out or "/vendor/" not in file[start] and "/vendor/" in file[other]):
                    continue
                if other not in seen:
                    seen[other] = d
                    fresh.append(other)
        layer = fresh
    seen.pop(start)
    return seen


def test_levels_against_a_plain_search(spark):
    r = random.Random(3)
    symbols = [symbol(i, f"n{i}", f"/r/{'vendor/' if i % 5 == 0 else ''}f{i % 7}.c", kind=10 if i % 11 == 0 else 0) for i in range(1, 40)]
    edges = list({(r.randrange(1, 42), r.randrange(1, 42), r.randrange(5)): None for _ in range(60)})
    edges = [(*e, i) for i, e in enumerate(edges)]
    g = graph(spark, symbols, edges)
    starts = spark.createDataFrame([(1, 1), (2, 5)], "rank bigint, id bigint")
    got = retrieve.levels(starts, g.symbols, g.edges, 4).groupBy("rank", "id").agg(F.min("level").alias("level")).collect()
    for rank, start in ((1, 1), (2, 5)):
        assert {x.id: x.level for x in got if x["rank"] == rank and x.id != start} == brute_levels(symbols, edges, start, 4)


def test_a_full_seed_set_leaves_no_room(spark):
    symbols = [symbol(i, f"thing_{i}", f"/r/f{i}.c") for i in range(1, 8)]
    g = graph(spark, symbols, [(1, 7, 0, 1)])
    seeds = index.task_seeds(g.symbols.where("id < 5"), g.edges, "thing")
    assert retrieve.collected(g.symbols, g.edges, seeds, budget=4).count() == 4
    more = {r.id: (r.score, r.reason) for r in retrieve.collected(g.symbols, g.edges, seeds, budget=5).collect()}
    assert set(more) == {1, 2, 3, 4, 7} and more[7] == (50.0, "callee")


def test_store_changes(spark):
    g = graph(spark, [symbol(1, "a", "/x.c"), symbol(2, "b", "/x.c"), symbol(3, "c", "/y.c")], [(1, 3, 0, 1), (3, 1, 0, 2), (3, 99, 0, 3)])
    changed = spark.createDataFrame([(*symbol(2, "b2", "/x.c")[:-1], 50), (*symbol(4, "d", "/z.c")[:-1], 51)], store.SYMBOLS)
    assert {(r.id, r.name, r.seq) for r in store.upserted(g.symbols, changed).collect()} == {(1, "a", 1), (2, "b2", 2), (3, "c", 3), (4, "d", 51)}
    left, edges = store.without_files(g.symbols, g.edges, spark.createDataFrame([("/x.c",)], "path string"))
    assert [r.id for r in left.collect()] == [3] and [(r.from_id, r.to_id) for r in edges.collect()] == [(3, 99)]
    assert store.added_edges(g.edges, g.edges.withColumn("seq", F.col("seq") + 10)).count() == 3
    a = spark.createDataFrame([("x", 1), ("y", 2)], store.STATS)
    assert {r.key: r.value for r in store.added_counters(a, a).collect()} == {"x": 2, "y": 4}


def test_pages(spark):
    rows = spark.createDataFrame([(i,) for i in range(170)], "seq int")
    found, total, number = listing.page(rows, 9, "seq")
    assert (total, number, [r.seq for r in found.collect()]) == (170, 2, list(range(160, 170)))
    assert listing.page(rows.limit(0), 3, "seq")[1:] == (0, 0)


def test_nearest_node_and_positions(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 5.0, 0.0, 4.0)], "id bigint, x double, y double, radius double")
    assert project.nearest_node(nodes, 3.0, 0.0).first().id == 2 and project.nearest_node(nodes, 50.0, 0.0).first() is None
    before = spark.createDataFrame([(1, 9.0, 8.0, 1.0, 2.0)], "id bigint, x double, y double, vx double, vy double")
    assert {r.id: (r.x, r.y, r.vx, r.vy) for r in project.placed(nodes, before).collect()} == {1: (9.0, 8.0, 1.0, 2.0), 2: (5.0, 0.0, 0.0, 0.0)}


def test_forces_come_to_rest(spark, sf):
    g = virtual_graph(spark, sf)
    nodes = project.placed(project.project_nodes(g.symbols, g.edges, 40)).toPandas()
    edges = project.project_edges(g.edges, project.project_nodes(g.symbols, g.edges, 40)).toPandas()
    after = project.moved(nodes, edges, 400)
    energy = lambda n: (n.vx**2 + n.vy**2).sum()
    assert energy(after) < 0.05 * energy(project.moved(nodes, edges, 1))


def test_handles():
    assert parse_id("18446744073709551615") == -1 and parse_id("18446744073709551616") is None and parse_id("-1") is None and parse_id("") is None
    assert parse_lines("5:1-999") == (5, 1, 999) and parse_lines("5:0-9") is None and parse_lines("5:1") is None


@pytest.mark.parametrize(
    "path,text,names,edges",
    [
        ("/a/live.c", LIVE_2, {("app_live_alpha", 0, 1, 3), ("app_live_beta", 0, 5, 7)}, {("app_live_beta", "app_live_alpha", 0)}),
        ("/a/m.py", "import os\nclass Alpha(Basis):\n    def run(self):\n        return helper(os.name)\n\ndef helper(x):\n    return x\n", {("Alpha", 2, 2, 4), ("run", 1, 3, 4), ("helper", 0, 6, 7), ("os", 8, 1, 1)}, {("Alpha", "Basis", 4), ("run", "helper", 0)}),
        ("/a/m.go", "package m\ntype Point struct {\n  x int\n}\nfunc (p Point) Move() {\n  shift(p)\n}\nfunc shift(p Point) {\n}\n", {("Point", 3, 2, 4), ("Move", 1, 5, 7), ("shift", 0, 8, 9)}, {("Move", "shift", 0)}),
        ("/a/m.rs", "struct Point { x: i32 }\nfn area(p: Point) -> i32 {\n  width_of(p)\n}\n", {("Point", 3, 1, 1), ("area", 0, 2, 4)}, {("area", "width_of", 0)}),
        ("/a/m.js", "class Shape extends Figure {\n}\nfunction draw(a) {\n  return render(a);\n}\n", {("Shape", 2, 1, 2), ("draw", 0, 3, 5)}, {("Shape", "Figure", 4), ("draw", "render", 0)}),
    ],
)
def test_extraction(path, text, names, edges):
    found, _ = extract_text(text, path)
    got = {(s["name"], s["kind"], s["line"], s["end_line"]) for s in found.symbols}
    assert names <= got
    assert edges <= {(a, b, k) for a, b, _, k in found.pending}
    assert found.errors == 0


def test_module_variables():
    c = "#include <a.h>\ntypedef int number_t;\nstatic int app_count = 3;\nconst char *app_names[] = { \"x\", \"y\" };\nstruct app_point { int inner_value; };\nint prototype(int arg_name);\nint app_main(void) {\n  int local_value = 1;\n  return local_value;\n}\nstd::vector<int> app_items;\nlong abcd;\n"
    of = lambda text, path: {(s["name"], s["line"]) for s in extract_text(text, path)[0].symbols if s["kind"] == 6}
    assert of(c, "/a/x.cpp") == {("app_count", 3), ("app_names", 4), ("app_items", 11)}
    assert of("pub static mut COUNTER: u32 = 0;\nconst LIMIT_OF: usize = 3;\nfn run() { let local_one = 1; }\n", "/a/x.rs") == {("COUNTER", 1), ("LIMIT_OF", 2)}


def test_presence_cases(spark, tree):
    engine = Engine.index(spark, str(tree / "src"), str(tree / "store"))
    found = cases.run(engine, [cases.Case("fix app_live_beta", ("live.c", "app_live_alpha")), cases.Case("fix app_live_beta", ("live.c", "absent_name", "more"))])
    assert [o.missing for o in found] == [None, "absent_name"] and found[0].size > 100
    text = cases.report(found)
    assert "[PASS]" in text and "missing: absent_name" in text and "=== 1/2 passed ===" in text and len(cases.OWN) == 7


def test_broken_sources_do_not_stop_extraction():
    assert extract_text("def (:", "/a/x.py")[0].errors == 1
    assert extract_text("int f( {{{ }", "/a/x.c")[0].errors > 0
    assert extract_text("", "/a/x.c")[0].symbols == []


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src" / "build").mkdir(parents=True)
    (tmp_path / "src" / "live.c").write_text(LIVE_2)
    (tmp_path / "src" / "_under.py").write_text("def under_score(x):\n    return app_live_beta(x)\n")
    (tmp_path / "src" / "build" / "skipped.c").write_text("int skipped(void) {\n}\n")
    (tmp_path / "src" / "binary.c").write_bytes(b"\0\1")
    return tmp_path


def test_index_query_and_expand(spark, tree):
    root = str(tree / "src")
    engine = Engine.index(spark, root, str(tree / "store"))
    names = {r.name: r.id for r in engine.graph.symbols.collect()}
    assert {"app_live_alpha", "app_live_beta", "under_score"} == set(names)
    assert {(r.from_id, r.to_id) for r in engine.graph.edges.collect()} == {(names["app_live_beta"], names["app_live_alpha"]), (names["under_score"], names["app_live_beta"])}

    out = engine.retrieve("task", "fix app_live_beta")
    assert "INTENT: edit" in out and "TERMS: fix app_live_beta" in out and "edit-target" in out and "relation: out app_live_alpha live.c:1" in out
    assert "FILE " in engine.retrieve("task", "fix app_live_beta", "full")
    assert engine.retrieve("task", "zzzz qqqq").startswith("ERROR: no symbols")
    assert "app_live_beta" in engine.retrieve("file", "live.c") and "under_score" in engine.retrieve("symbol", "under_score")

    uid = names["app_live_beta"] % 2**64
    assert "LINES" not in engine.expand(f"expand:lines:{uid}:1-999") and ":5-7\n" in engine.expand(f"expand:lines:{uid}:1-999")
    assert "return app_live_alpha() + 1;" in engine.expand(f"expand:source:{uid}")
    assert "under_score" in engine.expand(f"expand:callers:{uid}") and "app_live_alpha" in engine.expand(f"expand:callees:{uid}")
    assert "- entrypoints_total: 2" in engine.expand("expand:file:live.c") and "- entrypoints_listed: 2" in engine.expand("expand:entrypoints:live.c")
    assert "role: expanded" in engine.expand(f"expand:symbol:{uid}")
    for bad in ("x", "expand:file", "expand:symbol:zz", "expand:symbol:1", "expand:nothing:" + str(uid), f"expand:lines:{uid}:0-1"):
        assert engine.expand(bad).startswith("ERROR")
    assert '"symbols": 3' in engine.status()
    assert engine.list_symbols("beta")[1] == 1 and engine.list_calls()[1] == 2 and engine.list_files()[1] == 2

    (tree / "src" / "live.c").write_text(LIVE_3)
    import os

    os.utime(tree / "src" / "live.c", (1, 1))
    os.remove(tree / "src" / "_under.py")
    again = Engine.index(spark, root, str(tree / "store"))
    assert [r.name for r in again.graph.symbols.collect()] == ["app_live_alpha"] and again.graph.edges.count() == 0 and again.generation == 2


def test_stream_of_changes(spark, tree):
    root, folder = str(tree / "src"), tree / "changes"
    folder.mkdir()
    live, under = f"{root}/live.c", f"{root}/_under.py"
    keeper = maintain.Maintainer(store.GraphStore(spark, str(tree / "live")), extract_files)

    def send(n, *rows):
        import json

        (folder / f"c{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "kind", "path", "old_path"), r))) for r in rows))
        keeper.start(maintain.read_changes(spark, str(folder)), str(tree / "progress"), once=True).awaitTermination()
        return {r.name for r in keeper.store.load().symbols.collect()}

    assert send(1, (1, "created", live), (2, "created", under)) == {"app_live_alpha", "app_live_beta", "under_score"}
    assert keeper.store.load().edges.count() == 2
    (tree / "src" / "live.c").write_text(LIVE_3)
    assert send(2, (3, "modified", live), (4, "deleted", under)) == {"app_live_alpha"}
    shutil.move(live, f"{root}/moved.c")
    assert send(3, (5, "renamed", f"{root}/moved.c", live)) == {"app_live_alpha"}
    assert {r.file for r in keeper.store.load().symbols.collect()} == {f"{root}/moved.c"}


def test_last_changes_and_moves(spark):
    rows = [(1, None, "created", "/a", None), (2, None, "renamed", "/b", "/a"), (3, None, "deleted", "/c", None), (4, None, "created", "/c", None)]
    got = {r.path: r.gone for r in maintain.last_changes(spark.createDataFrame(rows, maintain.CHANGES)).collect()}
    assert got == {"/a": True, "/b": False, "/c": False}
    moves = spark.createDataFrame([(1, 7, "from", "/a"), (2, 7, "to", "/b"), (3, 8, "to", "/n"), (4, 9, "from", "/lost")], "seq bigint, cookie bigint, side string, path string")
    assert {(r.kind, r.path, r.old_path) for r in maintain.paired_moves(moves).collect()} == {("renamed", "/b", "/a"), ("created", "/n", None)}


def test_an_old_version_reads_as_no_graph(spark, tmp_path):
    g = graph(spark, [symbol(1, "a", "/x.c")])
    saved = store.GraphStore(spark, str(tmp_path))
    assert saved.load() is None
    files = spark.createDataFrame([], store.FILES)
    saved.save(Graph(g.symbols, g.edges, spark.createDataFrame([], store.PENDING), files))
    assert saved.load().symbols.count() == 1
    meta = tmp_path / "current" / "meta-1.json"
    meta.write_text(meta.read_text().replace('"schema_version": "2"', '"schema_version": "1"'))
    (tmp_path / "current" / ".meta-1.json.crc").unlink(missing_ok=True)
    assert saved.load() is None


def test_a_writer_that_dies_leaves_the_current_generation(spark, tmp_path, monkeypatch):
    saved = store.GraphStore(spark, str(tmp_path))
    none = spark.createDataFrame([], store.PENDING), spark.createDataFrame([], store.FILES)
    small, large = graph(spark, [symbol(1, "a", "/x.c")]), graph(spark, [symbol(1, "a", "/x.c"), symbol(2, "b", "/x.c")])
    saved.save(Graph(small.symbols, small.edges, *none))

    def dies(*_):
        raise KeyboardInterrupt

    for step in ("_publish", "_write"):
        monkeypatch.setattr(store.GraphStore, step, dies)
        with pytest.raises(KeyboardInterrupt):
            saved.save(Graph(large.symbols, large.edges, *none))
        monkeypatch.undo()
        assert saved.generation() == 1 and saved.load().symbols.count() == 1
    (tmp_path / "current" / "meta-2.json.new").write_text("half a poin")  # died before the rename
    assert saved.generation() == 1 and saved.load().symbols.count() == 1
    for n in (2, 3, 4):
        assert saved.save(Graph(large.symbols, large.edges, *none)) == n and saved.load().symbols.count() == 2
    assert saved._pointers() == [3, 4] and not (tmp_path / "generation-2").exists()


def test_a_common_name_costs_no_product(spark):
    rows = [symbol(i, "main", f"/m{i % 50}/f{i}.c") for i in range(1000)]
    symbols = graph(spark, rows).symbols
    sites = spark.range(100_000).selectExpr("concat('/m', id % 60, '/f', id % 2000, '.c') as caller_file", "'main' as caller_name", "'main' as callee_name", "1 as caller_line", "0 as kind", "id as seq")
    got = {r.seq: (r.target_id, r.score) for r in resolve.resolved_targets(sites.where("seq < 4000"), symbols).collect()}
    files = {r[2]: r[0] for r in rows}
    first = {f.rsplit("/", 1)[0]: i for f, i in reversed(files.items())}
    worth = got[50][1]  # neither its file nor its module has a symbol
    for n, found in got.items():
        file = f"/m{n % 60}/f{n % 2000}.c"
        module = file.rsplit("/", 1)[0]
        assert found == ((files[file], worth + 100) if file in files else (first[module], worth + 40) if module in first else (0, worth))
    began = time.monotonic()
    assert resolve.resolved_targets(sites, symbols).count() == 100_000
    assert time.monotonic() - began < 30


def test_an_include_chain_shuffles_none_of_its_rows(spark, monkeypatch):
    # 300 starts include a file of 400 symbols and another of 3; symbol 5000 stands in both, and vendor files are no target
    monkeypatch.setattr(retrieve, "LIST_IDS", 64)
    monkeypatch.setattr(retrieve, "PIECE_RANKS", 50)
    rows = [symbol(i, f"s{i}", "/a/start.c") for i in range(300)] + [symbol(1000 + i, f"t{i}", "/a/wide.h") for i in range(400)]
    rows += [symbol(2000 + i, f"u{i}", "/a/small.h") for i in range(3)] + [symbol(5000, "w", "/a/wide.h"), symbol(5000, "w", "/a/small.h"), symbol(3000, "v", "/vendor/v.h"), symbol(2003, "n", "/a/small.h", kind=10)]
    edges = [(i, to, 1, i) for i in range(300) for to in (1000, 1001, 2000, 2003, 3000)] + [(1, 2, 0, 9)]
    g = graph(spark, rows, edges)
    done = lambda: sum(x.shuffleWriteRecords() for x in _stages(spark))
    before = done()
    got = [tuple(r) for r in retrieve.include_chain(g.symbols.select("id", F.col("id").alias("rank")), g.symbols, g.edges).collect()]
    reached = [*range(1000, 1400), 2000, 2001, 2002, 5000]
    assert sorted(got) == [(i, j) for i in range(300) for j in reached]
    assert done() - before < len(got) / 4


def _stages(spark):
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]
