"""Small fixtures for report operators, token passes, masks, orders and streamed pairs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tallymill import report_queries
from tallymill.functions import text as T
from tallymill.operators import extract, graph, reports, scoring
from tallymill.sources import logs
from tallymill.streaming import counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_references_of_statements():
    tables, columns = extract.references("INSERT INTO l.entries (id, Amount) SELECT a, sum(b) AS t FROM db . s.f$x, [u v], z.q k WHERE c IN (1) AND f$x.d = 'x, y' AND k.e > 2 GROUP BY a ORDER BY t -- from h")
    assert tables == [("l.entries", "entries"), ("s.f$x", "f$x"), ("z.q", "k")] or ("s.f$x", "f$x") in tables and ("z.q", "k") in tables
    assert {("select", "l.entries", "id"), ("select", "l.entries", "amount"), ("select", "s.f$x", "a"), ("select", "s.f$x", "b"), ("where", "s.f$x", "c"), ("where", "s.f$x", "d"), ("where", "z.q", "e"), ("group_by", "s.f$x", "a")} == set(columns)
    assert extract.references("with w as (select a from x.y where b = 1) select w.a n from w")[0] == [("x.y", "y")]
    assert extract.references(None) == ([], []) and extract.references("'from t'") == ([], [])
    assert extract.references("select s.t.c from s.t join u on u.k = t.k")[1] == [("select", "s.t", "c"), ("join_on", "u", "k"), ("join_on", "s.t", "k")]


def test_masks(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    for text, want in [("k in (1, -2.5) and f(3) > 4", "k in (<N>, <N>) and f(3) > <N>"), ("x NOT IN ( 12,'a') or y=-1", "x NOT IN ( <N>,'<REDACTED>') or y=<N>"), ("in (1", "in (<N>"), ("", "")]:
        assert value(T.redact(F.lit(text))) == want
    assert value(T.redact(F.lit(None).cast("string"))) is None
    for text, column, want in [
        ("call 050-123-4567 now", "note", "call ***-***-**** now"), ("+1 (212) 555-0100", "note", "+1 (212) 555-0100"), ("+1 (212) 555-0100", "work_phone", "***-***-****"),
        ("Ada Lovelace", "customer_name", "***"), ("Ada Lovelace", "city", "Ada Lovelace"), ("1234567890123456", "x", "**** **** **** ****"), (" 123456789 ", "x", "*********"),
    ]:
        assert value(T.mask_pii(F.lit(text), column)) == want
    assert value(T.mask_rtl(F.lit("a \u05d0\u05d1 \u05d2 b"))) == "a [HE] b" and value(T.dialect(F.lit(" MSSQL "))) == "tsql" and value(T.dialect(F.lit(" "))) is None


def test_positions_cover_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as v", "id as _part")
    got = scoring.positions(df, [F.col("v").desc()])
    assert got.columns == ["v", "_part", "position"] and all(r.position == 1000 - r.v for r in got.collect())
    assert scoring.positions(df.where("v < 0"), ["v"]).count() == 0


def test_dependency_order_takes_what_nothing_holds_back(spark):
    priority = {"a": 3.0, "b": 9.0, "c": 9.0, "d": 1.0}
    edges = [("a", "b"), ("c", "d"), ("a", "d"), ("c", "b"), ("d", "x")]
    before = {t: set() for t in priority}
    for x, y in edges:
        if x in priority and y in priority:
            first, then = sorted((x, y), key=lambda t: (-priority[t], t))
            before[then].add(first)
    want, left = [], set(priority)
    while left:
        want.append(min((t for t in left if not before[t] & left), key=lambda t: (-priority[t], t)))
        left.remove(want[-1])
    got = reports.dependency_order(spark.createDataFrame(list(priority.items()), "table string, priority double"), spark.createDataFrame(edges, "a string, b string"))
    assert [r["table"] for r in got.orderBy("position").collect()] == want and got.first().lineage_used


def test_report_filters(spark):
    maps = spark.createDataFrame([("t", 0.9), ("t", 0.1), ("u", 0.9), ("v", 0.9), (None, 0.9)], "table string, confidence double")
    inv = spark.createDataFrame([("t", 1, "core"), ("u", 1, None), ("v", 2, "core")], "table string, domain int, portfolio string")
    assert rows(reports.mappings_in_scope(maps, inv, 0.5, [1], "debt")) == [("u", 0.9)] and reports.mappings_in_scope(maps, inv, 0.5, [1]).count() == 2
    queue = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9), (None, 0.6)], "k int, confidence double")
    chosen = spark.createDataFrame([(2, "approve"), (9, "reject")], "k int, action string")
    assert [r.k for r in reports.review_queue(queue, chosen, "k", batch=2).collect()] == [3, None] and reports.review_queue(queue, chosen, "k", status="approve").count() == 1
    cards = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "card int, tables array<string>")
    assert [r.card for r in reports.cards_in_scope(cards, spark.createDataFrame([("b",), ("b",)], "table string")).collect()] == [1]
    assert reports.renamed(queue, [("confidence", "sure")]).columns == ["sure"] and reports.renamed(queue, []).columns == queue.columns
    logged = spark.createDataFrame([("t", "A", 1.0, ["a"]), ("t", "b", 2.0, ["z", "b"])], "table string, column string, score double, sources array<string>")
    assert rows(reports.importance_report(logged)) == [("t", "A", 1.0, None), ("t", "b", 2.0, "b, z")]
    manifest = spark.createDataFrame([("T", "p"), ("t", "q")], "table_key string, path string")
    assert rows(reports.resolve_catalog(spark.createDataFrame([("t",), ("T",), ("w",)], "table string"), manifest, "d")) == [("T", "p"), ("t", "q"), ("w", "d")]


def test_tickets_are_flat(spark, tmp_path):
    logs.write_tickets(spark.createDataFrame([(1, " a \n\n  b\r\nc ")], "id int, note string"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().note == "a | b | c"


def test_streamed_pairs_are_those_of_the_batch(spark, tmp_path):
    lists = [["a", "b", "b"], ["b", "a", "c"], [None, "c"], [], ["c", "a"]]
    df = spark.createDataFrame([(x,) for x in lists], "items array<string>").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    want = Counter(p for x in lists for p in combinations(sorted({i for i in x if i}), 2))
    reports_of = []
    got = counts.drain(counts.pairs(counts.read_files(spark, str(tmp_path / "in"), files_per_trigger=1)), ["a", "b"], reports_of)
    assert {(r.a, r.b): r.weight for r in got.collect()} == want
    assert counts.progress(spark, reports_of).agg(F.sum("rows")).first()[0] == len(lists)


def test_streamed_sums_keep_no_state(spark, tmp_path):
    lists = [["a", "b", "b"], ["b", "a", "c"], [None, "c"], [], ["c", "a"]]
    df = spark.createDataFrame([(x,) for x in lists], "items array<string>").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    want = Counter(p for x in lists for p in combinations(sorted({i for i in x if i}), 2))
    got = counts.drain_sums(counts.read_files(spark, str(tmp_path / "in"), files_per_trigger=1), counts.pairs, ["a", "b"])
    assert {(r.a, r.b): r.weight for r in got.collect()} == want
    assert counts.drain_sums(counts.read_files(spark, str(tmp_path / "none")), counts.pairs, ["a", "b"]).count() == 0


def test_blast_radius_stops_when_nothing_new_is_reached(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(5)], "a int, b int, weight int")
    facts = spark.createDataFrame([(i, i % 2, 10.0 if i == 0 else 0.0) for i in range(6)], "node int, domain int, priority double")
    assert [(r.seed, r.reach, r.spread) for r in graph.blast_radius(edges, facts).collect()] == [(0, 4, 2)]
    assert graph.blast_radius(edges, facts, hops=99).first().reach == 6


def test_blast_radius_follows_contenders_alone(spark, monkeypatch):
    rnd = random.Random(8)
    followed, own = [], graph.positions
    monkeypatch.setattr(graph, "positions", lambda rows, *a: (followed.append(rows.count()), own(rows, *a))[1])
    for nodes, links, most in ((150, 1800, 5), (80, 60, 5), (40, 30, 200), (9, 0, 3)):
        pairs = {tuple(sorted(rnd.sample(range(nodes), 2))) for _ in range(links)}
        facts = [(n, rnd.choice([None, 1, 2, 3]), float(rnd.randrange(30))) for n in range(nodes) if n % 7]
        near = {n: {m for p in pairs if n in p for m in p} for n in range(nodes)}
        domain, want = {n: d for n, d, _ in facts}, []
        for seed, _, priority in facts:
            met = {seed}
            for _ in range(3):
                met |= set().union(*(near[n] for n in met))
            met = [n for n in met if n in domain]
            reach, spread = len(met), len({domain[n] for n in met} - {None})
            if priority >= 10 and (spread >= 2 or reach >= 4 or (spread >= 1 and reach >= 3) or (reach >= 2 and len(near[seed]) > 0)):
                want.append((seed, reach, spread, round(min(100.0, 22.0 * spread + 2.5 * reach + 0.15 * priority), 4)))
        edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a int, b int, weight int")
        got = graph.blast_radius(edges, spark.createDataFrame(facts, "node int, domain int, priority double"), most=most)
        assert [tuple(r) for r in got.collect()] == sorted(want, key=lambda r: (-r[3], r[0]))[:most]
    assert followed[0] < 40


def test_similarity_keeps_the_parts_of_a_graph_together(spark):
    rnd = random.Random(6)
    names = [f"n{x:04d}" for x in rnd.sample(range(10_000), 48)]
    groups = [names[i : i + 12] for i in range(0, 48, 12)]
    pairs = {tuple(sorted(p)): rnd.choice([1.0, 2.5, 16777217.0]) for g in groups for p in combinations(g, 2)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a string, b string, weight double")
    place = {r.node: r.p for r in graph._numbered(graph.symmetric(edges)).collect()}
    assert sorted(place.values()) == list(range(48)) and all(max(place[n] for n in g) - min(place[n] for n in g) == 11 for g in groups)
    w = {n: {} for n in names}
    for (a, b), x in pairs.items():
        w[a][b] = w[b][a] = x
    size = {n: sum(x * x for x in w[n].values()) ** 0.5 for n in names}
    want = {(a, b): (10, sum(w[a][k] * w[b][k] for k in w[a].keys() & w[b].keys()) / size[a] / size[b]) for g in groups for a, b in combinations(sorted(g), 2)}
    got = {(r.a, r.b): (r.shared, r.cosine) for r in graph.similarity(edges, 12, 0).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 2e-6 for k, v in want.items())


def test_sql_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"s{i}") for i in range(40)] + [(7, "again"), (7, "once more"), (None, "no key"), (41, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(logs, "FILES", 5, raising=False)
    monkeypatch.setattr(report_queries, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    got = sorted((str(r.name), r.text) for r in report_queries.sql_files(spark, str(tmp_path)).collect())
    assert got == sorted((str(k), f"SELECT {n or ''}\nFROM t") for k, n in rows)
    assert len({p.parent.name.split("-")[0] for p in (tmp_path / "sql").rglob("*.sql")}) > 4
    assert not [p for p in (tmp_path / "sql").rglob("*") if p.is_file() and p.suffix != ".sql"]


def test_sql_files_of_odd_names(spark, tmp_path):
    names = ["a/b", "..", ".hidden", "_x", "", "é%2F = 1", None, "plain"]
    logs.write_sql_files(spark.createDataFrame([(n, f"text of {n}") for n in names] + [("void", None)], "name string, text string"), str(tmp_path / "odd"))
    assert sorted(r.text for r in logs.read_sql_files(spark, str(tmp_path / "odd")).collect()) == sorted(["\n", *(f"text of {n}\n" for n in names)])


def test_edges_are_packed_before_they_are_copied(spark, monkeypatch):
    rnd = random.Random(9)
    pairs = {p: rnd.randrange(1, 4) for p in combinations(range(300), 2)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight long")
    packed, own = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, *a: (packed.append(own(df, *a)), packed[-1])[1])
    got = graph.similarity(edges, 64, 0, summed=True)
    assert got.count() == 300 * 299 // 2 and got.where("shared = 298").count() == got.count()
    cells = [df for df in packed if "data" in df.columns]
    assert len(cells) == 1 and cells[0].agg(F.sum("n")).first()[0] == 2 * len(pairs)
    assert cells[0].agg(F.sum(F.octet_length("data"))).first()[0] < 2 * len(pairs)  # a byte for an edge's both directions, eight before
    assert not [df for df in packed if df.columns == ["src", "dst", "weight"]]


def test_tiles_sum_all_ranges_and_any_weights(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANGE", 8)
    monkeypatch.setattr(graph, "PACKED", 100)
    rnd = random.Random(10)
    pairs = {p: rnd.choice([1.0, -2.0, 0.5, 0.1, 2.0**40, 0.0]) for p in combinations(range(50), 2) if rnd.random() < 0.5 or p[0] == 0}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a int, b int, weight double").repartition(3)
    w = {n: {} for n in range(50)}
    for (a, b), x in pairs.items():
        w[a][b] = w[b][a] = x
    size = {n: sum(x * x for x in w[n].values()) ** 0.5 for n in w}
    want = {(a, b): (len(w[a].keys() & w[b].keys()), sum(w[a][k] * w[b][k] for k in w[a].keys() & w[b].keys()) / size[a] / size[b]) for a, b in combinations(range(50), 2) if w[a].keys() & w[b].keys()}
    for summed in (False, True):
        for hub in (0, 26):  # tiles alone, tiles and joins
            got = {(r.a, r.b): (r.shared, r.cosine) for r in graph.similarity(edges, 12, hub, summed).collect()}
            assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 2e-6 for k, v in want.items())


def test_similarities_are_counted_without_being_written(spark, tmp_path, monkeypatch):
    from tallymill import checking_queries
    from tallymill.operators import quality

    lines = [(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3), (4, 9), (None, 5), (6, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    written, own = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, *a: (written.append(df.columns), own(df, *a))[1])
    assert tuple(checking_queries.co_occurrence_figures(spark, str(tmp_path)).first()) == (4, 3, 3, 3)
    assert written == [["a", "b", "weight"]]
