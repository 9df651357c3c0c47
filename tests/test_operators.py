"""Small fixtures for the library's own operators."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from tallymill.functions import text as T
from tallymill.operators import baskets, extract, graph, scoring
from tallymill.operators.components import components
from tallymill.sources import logs

F = pytest.importorskip("pyspark.sql.functions")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairs_count_each_statement_once(spark):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "c"), (None, "a"), (4, None)], "s int, t string")
    b = baskets.baskets(log, "s", "t")
    assert rows(baskets.pair_weights(b)) == [("a", "b", 2)]
    assert rows(baskets.pair_weights(b, max_weight=1)) == [("a", "b", 1)]
    assert rows(baskets.table_counts(b)) == [("a", 2), ("b", 2), ("c", 1)]


def test_counts_do_not_depend_on_parts(spark):
    log = spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "x")], "i string, r string")
    once = baskets.role_counts(log, "i", "r", ["x", "y"])
    assert rows(baskets.merge_counts(once, once, keys=["item"])) == [("t", 2, 2), ("u", 2, 0)]


def test_environment_filter_keeps_rows_without_one(spark):
    log = spark.createDataFrame([("Prod",), ("",), (None,), ("staging",)], "env string")
    assert baskets.environment(log, "env", "prod").count() == 3
    assert baskets.environment(log, "env", " ").count() == 4


def test_candidates_need_a_least_count_and_rank_ties_by_name(spark):
    pairs = spark.createDataFrame([("t", "b", 3), ("t", "a", 3), ("t", "c", 8), ("u", "a", 2)], "token string, follower string, n long")
    assert rows(baskets.candidates(pairs)) == [("t", 1, "c", 8), ("t", 2, "a", 3), ("t", 3, "b", 3)]


@pytest.mark.parametrize("edges,expected", [([], []), ([(1, 1)], []), ([(2, 1), (2, 3), (9, 8)], [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]), ([(i, i + 1) for i in range(60)], [(i, 0) for i in range(61)])])
def test_components(spark, edges, expected):
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == expected


def test_clusters_keep_singletons(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(5)], "node long"), spark.createDataFrame([(0, 1, 5), (1, 2, 1)], "a long, b long, weight long")
    assert rows(graph.clusters(nodes, edges, least=2)) == [(0, 2, 5), (2, 1, 0), (3, 1, 0), (4, 1, 0)]


def test_neighbourhood_of_a_lone_node_is_empty(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (1, 3, 1), (3, 4, 1)], "a long, b long, weight long")
    assert rows(graph.neighbourhood(edges, 1)) == [(1, 2, 3, "spoke"), (1, 3, 1, "spoke"), (2, 3, 1, "rim")]
    assert graph.neighbourhood(edges, 99).isEmpty()


def test_queue_order_of_rules(spark):
    df = spark.createDataFrame([(90.0, 85, False, False), (90.0, 10, True, False), (60.0, 10, False, False), (80.0, 10, False, False), (90.0, 10, False, True), (90.0, 10, False, False), (90.0, 60, False, False)], "c double, k int, b boolean, w boolean")
    got = [r[0] for r in df.select(scoring.queue(F.col("c"), F.col("k"), F.col("b"), F.col("w"))).collect()]
    assert got == ["red", "red", "red", "yellow", "yellow", "green", "yellow"]


def test_width_outlier_alone_is_found(spark):
    df = spark.createDataFrame([("d", 10)] * 10 + [("d", 30)], "domain string, width int")
    assert rows(scoring.width_outliers(df, "domain", "width")) == [("d", 30)]


def test_extraction_resolves_aliases(spark):
    log = spark.createDataFrame([(1, "select o.id, x.q from S.Orders o join crm.cust as c on o.c = c.id where c.name = 'a' order by o.id"), (2, "-- nothing"), (3, None)], "stmt int, sql string")
    tables = extract.table_refs(log)
    assert rows(tables) == [(1, 0, "s.orders", "o"), (1, 1, "crm.cust", "c")]
    got = [r[:1] + r[2:] for r in rows(extract.column_refs(log))]
    assert (1, "select", "s.orders", "q") in got and (1, "where", "crm.cust", "name") in got and (1, "order_by", "s.orders", "id") in got
    assert rows(extract.outcome(log)) == [(1, "regex"), (2, "skipped_empty"), (3, "skipped_empty")]


def test_log_reader_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sql": "", "query": "q1", "env": "prod"}\n\n  \nnot json\n{"statement": "s\\u0000"}\n')
    parsed = logs.parse_log(logs.lines(spark, str(tmp_path)))
    assert parsed.where("corrupt is not null").count() == 1
    assert [r.sql for r in logs.read_log(spark, str(tmp_path)).orderBy("sql").collect()][0] == "q1"
    assert logs.dead_letters(parsed, "ingest", "r1").select("error_reason").first()[0] == "invalid JSON"


def test_message_reader_keeps_other_fields(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"body": "hi", "timestamp": "1", "channel": "c", "user": "u"}\n{"text": ""}\n')
    row = logs.read_messages(spark, str(tmp_path)).collect()
    assert [(r.text, r.ts, r.channel, r.meta) for r in row] == [("hi", "1", "c", {"user": "u"})]


@pytest.mark.parametrize(
    "function,value,expected",
    [
        (T.normalize_name, ' "Order  Id" ', "order_id"), (T.normalize_name, "Été x", "Été_x"), (T.manifest_key, "A.B.C", "b.c"), (T.low_signal, "col7", True), (T.low_signal, "name", False),
        (T.redact, "a = 5 and b = N'it''s'", "a = <N> and b = '<REDACTED>'"), (T.mask_pii, "john@x.com", "j***@***.com"), (T.mask_pii, "123456789", "*********"), (T.mask_pii, "1111 2222 3333 4444", "**** **** **** ****"),
        (T.strip_blocks, "a {{ b\nc }} d", "a  d"), (T.slug, "ECO brass/5", "eco-brass-5"), (T.dedupe_key, " A \n b ", "a b"), (T.sanitize, "a\x00\tb\x1f", "a\tb"), (T.ascii_ratio, "", 1.0), (T.ascii_ratio, "aé", 0.5),
    ],
)
def test_text_functions(spark, function, value, expected):
    assert spark.createDataFrame([(value,)], "c string").select(function(F.col("c"))).first()[0] == expected


def test_split_name(spark):
    got = [tuple(r[0]) for r in spark.createDataFrame([("t",), ("s.t",), ("d.s.t",), ("a.b.c.d",)], "c string").select(T.split_name(F.col("c"))).collect()]
    assert got == [(None, None, "t"), (None, "s", "t"), ("d", "s", "t"), ("a", "b.c", "d")]


def test_stream_windows_count_rows_older_than_an_early_outlier(spark, tmp_path):
    from tallymill import registry

    for ts in ["2099-01-01", *["2020-01-01"] * 20]:
        part = spark.sql(f"SELECT TIMESTAMP'{ts} 00:00:00' AS ts, 'click' AS event_type").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = registry.stream_windows(spark, str(tmp_path)).collect()
    assert sorted((r.day.year, r.n) for r in got) == [(2020, 20), (2099, 1)]


def test_no_module_defines_a_name_twice():
    import ast
    from collections import Counter
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("*.py"), *(root / "tallymill").rglob("*.py"), *(root / "tests").rglob("*.py")]:
        count = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
        assert max(count.values(), default=1) == 1, path


def test_pairs_are_dealt_by_the_number_of_baskets(spark, monkeypatch, capsys):
    rnd = random.Random(4)
    data = {(rnd.randrange(40), rnd.randrange(9)) for _ in range(200)}
    b = spark.createDataFrame(list(data), "stmt int, item int")
    monkeypatch.setattr(baskets, "PART", 10)
    want = Counter(p for s in range(40) for p in combinations(sorted(i for t, i in data if t == s), 2))
    got = baskets.pair_weights(b)
    assert {(r.a, r.b): r.weight for r in got.collect()} == want
    got.explain()
    assert f"hashpartitioning(stmt#, {-(-len(data) // 10)}), REPARTITION_BY_NUM" in re.sub(r"#\d+", "#", capsys.readouterr().out)
    assert baskets.pair_weights(b.limit(0)).count() == 0


def test_normal_forms_come_piece_by_piece(spark, monkeypatch):
    import unicodedata

    import pyarrow as pa

    texts = ["e\u0301" * 50, None, "", "plain", "\ufb01" * 700, "\u1112\u1161\u11ab"] * 3
    monkeypatch.setattr(T, "PIECE", 64)
    got = T._normalized(pa.array(texts), "NFC").to_pylist()
    assert got == [x and unicodedata.normalize("NFC", x) for x in texts] and T._normalized(pa.array([], pa.string()), "NFC").to_pylist() == []
    df = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    for compatible in (False, True):
        want = [x and unicodedata.normalize("NFKC" if compatible else "NFC", x) for x in texts]
        assert sorted(map(str, want)) == sorted(str(r[0]) for r in df.select(T.normal_form(F.col("t"), compatible)).collect())


def test_repeats_count_once_without_a_written_table(spark, monkeypatch):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "c"), (None, "a"), (4, None), (5, "b"), (5, "c")], "s int, t string").repartition(3)
    want = rows(baskets.pair_weights(baskets.baskets(log, "s", "t")))
    monkeypatch.setattr(baskets, "materialize", None)
    assert rows(baskets.pair_weights(baskets.touches(log, "s", "t"), repeats=True)) == want == [("a", "b", 2), ("b", "c", 1)]
    assert baskets.pair_weights(baskets.touches(log.limit(0), "s", "t"), repeats=True).count() == 0


def test_all_peers_of_an_item_count(spark):
    pairs = [(0, i, 1 + i % 7) for i in range(1, 121)] + [(3, 5, 6), (3, 9, 6)]
    edges = spark.createDataFrame(pairs, "a long, b long, weight long")
    got = {r.item: (r.n_peers, r.peer_weight, r.best_peer) for r in baskets.co_peers(edges).collect()}
    assert got[0] == (120, sum(1 + i % 7 for i in range(1, 121)), 6)
    assert got[3] == (3, 16, 5) and got[120] == (1, 2, 0) and len(got) == 121
    assert baskets.co_peers(edges.limit(0)).count() == 0


def test_all_clusters_are_listed(spark):
    nodes = spark.range(9001).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 3), (7, 8, 3), (8, 9, 2)], "a long, b long, weight long")
    got = graph.clusters(nodes, edges, least=3).collect()
    assert len(got) == 8998 and sum(r["size"] for r in got) == 9001
    assert [tuple(r) for r in got[:4]] == [(0, 3, 8), (7, 2, 3), (3, 1, 0), (4, 1, 0)] and got[-1].cluster == 9000
