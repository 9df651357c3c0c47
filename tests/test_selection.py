"""Small fixtures for filters, selections and unions."""

import hashlib

import pytest

from tallymill.operators import selection as L

F = pytest.importorskip("pyspark.sql.functions")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scope_matches_full_and_short_names(spark):
    df = spark.createDataFrame([("dbo.Orders",), ("orders",), ("x.dbo.orders",), ("my_orders",), (None,)], "k string")
    assert [r[0] for r in df.select(L.in_scope(F.col("k"), " DBO.orders")).collect()] == [True, True, True, False, None]


def test_first_text_skips_blanks(spark):
    df = spark.createDataFrame([(" ", "b"), (None, ""), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(L.first_text("x", "y")).collect()] == ["b", None, "a"]


def test_only_green_proceeds(spark):
    got = L.bulk_split(spark.createDataFrame([(1,), (1,), (2,), (3,)], "item int"), spark.createDataFrame([(1, "green"), (2, "red")], "item int, queue string"))
    assert rows(got) == [(1, True, None), (2, False, "queue is red"), (3, False, "queue is unknown")]


def test_first_layer_wins_and_notes_go(spark):
    df = spark.createDataFrame([(0, "Net Sum", "a"), (1, "net_sum", "b"), (1, "_note", "c"), (1, "x", "d")], "layer int, term string, target string")
    assert rows(L.layered_glossary(df)) == [("net_sum", "a", 0), ("x", "d", 1)]


def test_first_occurrence_over_parts(spark):
    a, b = spark.createDataFrame([("x", 5), ("", 1)], "k string, o int"), spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, o int")
    assert rows(L.ordered_union(a, b, key="k", order="o")) == [("x", 0, 5), ("y", 1, 2)]


def test_changes_are_found_by_digest(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, content string")
    old = spark.createDataFrame([("a", sha("1")), ("b", sha("1")), ("z", sha("9"))], "key string, digest string")
    assert [(r["key"], r["change"]) for r in L.changed(new, old).orderBy("key").collect()] == [("a", "same"), ("b", "changed"), ("c", "added"), ("z", "removed")]


def test_points_are_rounded_half_to_even(spark):
    df = spark.createDataFrame([("t", i < 1, i < 3) for i in range(4)] + [("u", True, True)], "item string, matched boolean, typed boolean")
    assert rows(L.confidence_scores(df)) == [("t", 18 + 22), ("u", 100)]


def test_batches_split_at_go_lines_only(spark):
    df = spark.createDataFrame([(1, "SELECT go\nGO\n\nUSE db\ngo\nSELECT 2 -- GO"), (2, None), (3, "GO")], "script int, text string")
    assert rows(L.batches(df)) == [(1, 0, "SELECT go"), (1, 2, "SELECT 2 -- GO")]


def test_history_keeps_last_times_inside_whole_days(spark):
    df = spark.sql("SELECT timestamp(t) AS ran_at, sql FROM VALUES ('2024-01-01 00:00:00', 'a'), ('2024-01-02 23:59:59', 'a'), ('2024-01-03 00:00:00', 'b'), ('2024-01-01 05:00:00', 'c'), ('2024-01-01 06:00:00', ' ') AS v(t, sql)")
    assert [r["sql"] for r in L.history(df, "2024-01-01", "2024-01-02", 5).collect()] == ["a", "c"]


def test_file_score_counts_names_and_clauses(spark):
    df = spark.createDataFrame([("SELECT * FROM dbo.orders JOIN orders o",), (None,)], "t string")
    assert [r[0] for r in df.select(L.file_score(F.col("t"), "dbo", "orders")).collect()] == [4 + 4 + 3, 0]


def test_nearest_puts_zero_vectors_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, -1.0]), (5, None)], "vec_id int, embedding array<double>")
    assert [tuple(r) for r in L.nearest(df, [2.0, 0.0], 4).collect()] == [(2, 1.0), (3, 1.0), (4, 0.0), (1, None)]


def test_tickets_are_flat_and_short(spark):
    got = L.tickets(spark.createDataFrame([("t", 1)], "item string, wave int"), spark.createDataFrame([("t", "a\n b" + "x" * 9)], "item string, text string"), longest=6)
    assert rows(got) == [("Epic", "Wave 1", "", "1 table(s)"), ("Story", "Migrate t", "Wave 1", "a / bx")]
