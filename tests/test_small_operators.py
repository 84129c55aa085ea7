"""Operators and functions that no registered query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import config_text, paths, symbols, text
from lodestrand.operators import project, store
from lodestrand.plans.virtual import Graph
from lodestrand.streaming import maintain


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_file_rows_are_merged_by_path(spark):
    old = spark.createDataFrame([("/a", 1, 10, "", 0, 0), ("/b", 1, 10, "", 0, 0)], store.FILES)
    new = spark.createDataFrame([("/b", 2, 20, "", 0, 1), ("/c", 2, 20, "", 0, 0)], store.FILES)
    assert sorted((r.path, r.mtime) for r in store.merged_files(old, new).collect()) == [("/a", 1), ("/b", 2), ("/c", 2)]
    assert store.merged_files(old.limit(0), new).count() == 2 and store.merged_files(old, new.limit(0)).count() == 2


def test_counters_are_kept_over_generations(spark, tmp_path):
    saved = store.GraphStore(spark, str(tmp_path))
    assert saved.stats().count() == 0 and saved.stat("files") is None
    none = [spark.createDataFrame([], s) for s in (store.SYMBOLS, store.EDGES, store.PENDING, store.FILES)]
    files = spark.createDataFrame([("/a", 1, 10, "", 0, 0)], store.FILES)
    for run in (1, 2):
        saved.save(Graph(*none[:3], files), lambda edges: store.index_counters(files, none[0], edges, 3, 50))
        assert {r.key: r.value for r in saved.stats().collect()} == {"files": run, "symbols_found": 0, "edges_found": 0, "errors": 3 * run, "index_ms": 50 * run, "index_runs": run}
    saved.save(Graph(*none[:3], files))
    assert saved.stat("index_runs") == 2 and saved.stat("absent") is None


def test_changes_are_counted_by_kind_and_window(spark):
    rows = [(1, "2024-01-01 00:00:10", "created", "/a", None), (2, "2024-01-01 00:00:50", "created", "/b", None), (3, "2024-01-01 00:01:10", "created", "/c", None), (4, None, "deleted", "/c", None)]
    changes = spark.createDataFrame(rows, "seq bigint, ts string, kind string, path string, old_path string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((str(r.window.start), r.kind, r.n) for r in maintain.change_counts(changes).where("window is not null").collect())
    assert got == [("2024-01-01 00:00:00", "created", 2), ("2024-01-01 00:01:00", "created", 1)]
    counters = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value bigint")
    assert {r.key: r.value for r in maintain.running_counters(counters, counters.where("key = 'b'")).collect()} == {"a": 1, "b": 4}


def test_kinetic_energy(spark):
    nodes = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 1.0)], "id bigint, vx double, vy double")
    assert project.kinetic_energy(nodes).first().energy == 26.0


def test_string_functions(spark):
    assert column(spark, [('a"b',), ("c\\d",)], "s string", text.toml_escaped(F.col("s"))) == ['a\\"b', "c\\\\d"]
    assert column(spark, [("abcd",), ("abcdef",), ("",)], "s string", text.is_noise(F.col("s"))) == [True, False, True]
    assert column(spark, [("/abs",), ("rel.c",)], "s string", paths.resolved(F.col("s"), F.lit("/root"))) == ["/abs", "/root/rel.c"]
    assert column(spark, [("rel.c",)], "s string", paths.resolved(F.col("s"), F.lit(""))) == ["rel.c"]
    labels = column(spark, [(0,), (2,), (7,)], "lang int", symbols.lang_label(F.col("lang")))
    assert len(set(labels)) == 3
    rows = [(0, 50.0, "callee"), (0, 10.0, "query match"), (8, 90.0, "query match"), (0, 10.0, "callee")]
    assert column(spark, rows, "kind int, score double, reason string", symbols.is_edit_target(F.lit("edit"))) == [True, True, False, False]
    assert column(spark, rows, "kind int, score double, reason string", symbols.is_edit_target(F.lit("explain"))) == [False, False, False, False]


def test_json_objects_are_merged():
    assert json.loads(config_text.merged_json(None, ("servers", "own"), {"a": 1})) == {"servers": {"own": {"a": 1}}}
    old = '{"servers": {"other": 1, "own": 2}, "x": "é"}'
    new = config_text.merged_json(old, ("servers", "own"), 3)
    assert json.loads(new) == {"servers": {"other": 1, "own": 3}, "x": "é"} and new.endswith("}\n") and "é" in new
    for bad in ("[]", '{"servers": 1}', "{"):
        with pytest.raises(ValueError):
            config_text.merged_json(bad, ("servers", "own"), 3)
