"""Small fixtures for catalog readers, statement filters and table checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymill.operators import quality as Q
from tallymill.sources import catalogs as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_chat_export_skips_blank_messages(spark, tmp_path):
    for channel, day in (("a", [{"text": "hi", "ts": "1"}, {"text": " ", "ts": "2"}]), ("b", [{"ts": "3"}])):
        (tmp_path / channel).mkdir()
        (tmp_path / channel / "d.json").write_text(json.dumps(day, indent=1))
    assert rows(K.chat_export(spark, str(tmp_path))) == [("a", "1", "hi")]


def test_catalogs_of_both_shapes(spark):
    df = spark.createDataFrame([("a", '["x", {"name": "y", "type": "int"}, ""]'), ("b", '{"columns": ["z"]}'), ("c", "{"), ("d", None)], "table_key string, value string")
    assert rows(K.column_catalog(df)) == [("a", 0, "x", ""), ("a", 1, "y", "int"), ("b", 0, "z", "")]


def test_manifest_skips_notes(spark):
    got = K.manifest_entries(texts(spark, '{"_c": "n", "S.T": "p.json", "u": {"path": "q", "owner": "o"}}', "[", None))
    assert rows(got) == [("s.t", "p.json", None, None, None), ("u", "q", None, "o", None)]


def test_created_tables_have_their_own_tablespace(spark):
    df = spark.createDataFrame([(1, "CREATE TABLE a.B (x INT);\nCREATE TABLE c (y INT) IN ts1"), (2, None), (3, "SELECT 1")], "script int, sql string")
    assert rows(K.created_tables(df)) == [(1, "a.b", "a", None), (1, "c", None, "ts1")]


def test_comments_by_fullest_name(spark):
    items = spark.createDataFrame([(1, "d", "s", "T"), (2, "d", "x", "t"), (3, "d", "x", "u")], "k int, db string, schema string, table string")
    notes = spark.createDataFrame([("D.S.t", "full"), ("s.t", "mid"), ("t", "bare")], "key string, comment string")
    assert [(r["k"], r["comment"]) for r in K.side_metadata(items, notes).orderBy("k").collect()] == [(1, "full"), (2, "bare"), (3, None)]


def test_latest_entries_skip_bad_lines(spark, tmp_path):
    (tmp_path / "log").write_text('{"a": 1, "timestamp": "2024-01-01T00:00:00Z"}\n{bad\n{"a": 2, "timestamp": "2024-01-02T00:00:00Z"}\n')
    assert [r["a"] for r in K.latest_entries(spark, str(tmp_path), "a int", 1).collect()] == [2]


def test_noise_and_schemas(spark):
    df = spark.createDataFrame([("exec sp_who",), ("select 1 from a.b",), (None,), ("use x",), ("select user from [A].c",)], "s string")
    assert [tuple(r) for r in df.select(K.is_noise(F.col("s")), K.mentions_schema(F.col("s"), ["a"])).collect()] == [(True, False), (False, True), (True, False), (True, False), (False, True)]


def test_checks_of_empty_tables(spark):
    none = spark.createDataFrame([], "v string")
    got = Q.suite([Q.not_empty(none, "n"), Q.version_is(none, "v", "v", "1"), Q.check(none, "c", F.max("v") == "x")])
    assert rows(got) == [("c", "ok", ""), ("n", "error", "0"), ("v", "error", "0")]
    assert rows(Q.verdict(got)) == [(False, 2, 0, 1)]


def test_fields_and_columns_that_do_not_fit(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert rows(Q.invalid_fields(df, {"a": "int"})) == [("a", 1, 1)]
    cols = lambda *v: spark.createDataFrame([("t", c) for c in v], "table_key string, col string")
    assert rows(Q.conformance(cols("A", "b"), cols("a", "c"))) == [("t", "b", "missing"), ("t", "c", "unexpected")]


def test_scorer_hook_only_raises(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d")], "name string, col string")
    hook = lambda name, col: F.when(name == "a", 0.9)
    assert [r["confidence"] for r in Q.with_scorer(df, F.lit(0.5), hook).orderBy("name").collect()] == [0.9, 0.5]
    assert [r["confidence"] for r in Q.with_scorer(df, F.lit(0.5)).collect()] == [0.5, 0.5]
