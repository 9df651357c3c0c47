"""Scored filters, inventories, first mappings, neighbourhoods, labels, masks and odd lines: small cases with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill.functions import names as N
from tallymill.functions import text as T
from tallymill.operators import baskets, concepts, extract, graph, mapping, quality, reports, rules, scoring, selection
from tallymill.sources import bundles, catalogs, logs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c).first()[0]


def text(x):
    return F.lit(x).cast("string")


def test_scored_query(spark):
    scored = spark.createDataFrame([("a.t", "X", "green", "Ready", 50, 5), ("A.u", "x", "red", "Ready", 50, 5), ("b", None, None, None, 90, 5), ("a.v", "X", "green", None, None, 5)], "item string, domain string, queue string, status string, confidence int, criticality int")
    flags = spark.createDataFrame([("a.t", "WARN", "z"), ("a.t", "WARN", "z"), ("a.t", "BLOCK", "unsupported_blob_type"), ("b", None, "q"), (None, "WARN", "z")], "item string, level string, name string")
    ask = lambda **how: [r.item for r in selection.scored_query(scored, flags, **how).collect()]
    assert ask() == ["b", "A.u", "a.t"] and ask(descending=False) == ["A.u", "a.t", "b"] and ask(most=1) == ["b"]
    assert ask(schema="A", domain="x") == ["A.u", "a.t"] and ask(queue="GREEN") == ["a.t"] and ask(status="ready") == []
    assert ask(anomaly_level="warn") == ["a.t"] and ask(has_blob=True) == ["a.t"] and ask(schema="") == ask()
    assert selection.scored_query(scored, flags, queue="green").first().flags == ["BLOCK:unsupported_blob_type", "WARN:z"]
    assert selection.scored_query(scored.limit(0), flags).count() == 0
    assert rows(selection.bulk_split(scored, scored, "red")) == [("*", False, "a bulk of the red queue is refused")] and selection.bulk_split(scored, scored, dry_run=True).count() == 0


def test_scoped_inventory(spark):
    counts = spark.createDataFrame([("db.s.t", 4), ("junk.t", 2), ("s.t_temp", 1), ("plain", 9), (None, 1)], "item string, query_count long")
    scope = spark.createDataFrame([("db.s.t", True), ("db.s.t", None), ("s.t_temp", False)], "item string, merged boolean")
    got = {r.item: (r.database, r.schema, r.table, r.column_count, r.priority, r.status) for r in scoring.scoped_inventory(counts, counts.select("item", F.col("query_count").alias("column_count")).where("query_count > 1"), scope, "main").collect()}
    assert got == {"db.s.t": ("db", "s", "t", 4, 44.44, "Merged"), "junk.t": ("main", "junk", "t", 2, 22.22, "Ephemeral"), "s.t_temp": ("main", "s", "t_temp", 0, 11.11, "Needs Review")}
    assert scoring.scoped_inventory(counts.limit(0), counts.limit(0).withColumnRenamed("query_count", "column_count"), scope).count() == 0


def test_first_mappings(spark):
    df = spark.createDataFrame([("t", "c", "b", 1), ("t", "c", "a", 1), ("t", None, "z", 2), ("t", None, None, 3), ("t", "c", "a", 1)], "table_key string, target string, name string, n int")
    assert set(rows(mapping.first_mappings(df, ["n", "name"]))) == {("t", None, "z", 2), ("t", "c", "a", 1)}
    assert mapping.first_mappings(df.limit(0), ["n"]).count() == 0


def test_candidates_leave_the_best_and_few_reach_python(spark):
    columns = [f"{a}_{b}" for a in ("order", "customer", "price", "ship", "amount") for b in ("id", "date", "total", "name", "status", "code")]
    asked = ["ordr_id", "cust_name", "amount_totl", "id", "zzz", "", "ship_date_x", "שם"]
    catalog = spark.createDataFrame([("t", c) for c in columns], "table_key string, col string")
    names = spark.createDataFrame([("t", n) for n in asked], "table_key string, name string")
    best = lambda pairs: {r["name"]: (r.target, round(r.score, 9)) for r in mapping.best_candidate(pairs).collect()}
    assert best(mapping.best_blended(names, catalog)) == best(mapping.blended(names, catalog))
    left = {r["name"]: r["count"] for r in mapping.candidates(names, catalog).groupBy("name").count().collect()}
    assert left["id"] >= 24 and sum(n for k, n in left.items() if k != "id" and len(k) > 2) < 0.6 * 5 * len(columns)
    bounds = names.crossJoin(catalog.select("col")).select(N.lexical_ratio(F.col("name"), F.col("col")).alias("r"), N.ratio_bounds(F.col("name"), F.col("col"), N.character_counts(F.col("name")), N.character_counts(F.col("col"))).alias("b"))
    assert bounds.where("r < b.low - 1e-9 or r > b.high + 1e-9").count() == 0
    peers = spark.createDataFrame([("t", "id", "price")], "table_key string, name string, peer string")
    boosted = lambda pairs: rows(mapping.best_candidate(pairs, peers))
    assert [r[:3] for r in boosted(mapping.best_blended(names, catalog))] == [r[:3] for r in boosted(mapping.blended(names, catalog))]


def test_similarity_by_tiles_and_by_join_agree(spark):
    import itertools
    import random

    rnd = random.Random(3)
    pairs = {(a, b): rnd.randrange(1, 99) for a, b in itertools.combinations(range(60), 2) if rnd.random() < 0.25 or a < 3}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight long")
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    want = []
    for a, b in itertools.combinations(sorted(near), 2):
        both = near[a].keys() & near[b].keys()
        if both:
            size = lambda n: sum(w * w for w in near[n].values()) ** 0.5
            want.append((a, b, len(both), round(sum(near[a][k] * near[b][k] for k in both) / (size(a) * size(b)), 6)))
    for block, hub in ((512, 10**9), (7, 0), (16, 30)):  # only joins, only tiles, both
        got = rows(graph.similarity(edges, block, hub))
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want, key=str)))
    named = edges.select(F.format_string("n%02d", "a").alias("a"), F.format_string("n%02d", "b").alias("b"), "weight")
    assert graph.similarity(named, 16, 0).count() == len(want) and graph.similarity(edges.limit(0)).count() == 0


def test_neighbourhoods_by_name(spark):
    edges = spark.createDataFrame([("s.Orders", "s.items", 2), ("s.items", "s.x", 1)], "a string, b string, weight int")
    broken = spark.createDataFrame([("s.items",), ("s.items",), (None,)], "node string")
    assert [graph.resolve_node(edges, n) for n in ("s.x", "DB.[s].items", "S.ORDERS", "db.s.orders", "nothing")] == ["s.x", "s.items", "s.Orders", "s.Orders", None]
    nodes, near, reason = graph.neighbourhood_of(edges, "s.orders", broken)
    assert rows(nodes) == [("s.Orders", "centre"), ("s.items", "broken")] and near.count() == 1 and reason == ""
    assert [graph.neighbourhood_of(edges, n, broken)[2] for n in (" ", "q", None)] == ["missing_center_table", "not_in_graph", "missing_center_table"]
    assert graph.neighbourhood_of(edges, "q", broken)[0].count() == 0


def test_labels_and_lines(value):
    assert [value(T.label(text(x))) for x in (" A, b;|c - ", "שלום עולם", "", None, " -,- ")] == ["A-b-c", "שלום-עולם", "migration", "migration", "migration"]
    assert [value(T.one_line(text(x))) for x in ("a\r\n\n  b   c \rd", "", None, " \n ")] == ["a | b c | d", "", "", ""]
    assert [value(T.band(text(x))) for x in ("80", "60.5", "x", None)] == ["Highest", "High", "Low", "Low"] and [value(T.short_band(F.lit(x))) for x in (70, 69.9, 1)] == ["high", "medium", "low"]
    assert value(T.table_label(text("S.T"))) == "table-s-t" and value(T.manifest_key(text('db.[S x]."T"'))) == "s_x.t"
    assert tuple(value(T.ascii_names(F.array(text("a"), text("é"), text(None), text("b"))))) == (2, 1, 3, "a, b")


def test_masks_of_every_kind(value):
    for said, column, want in [
        ("a.b@x.com 1111-2222-3333-4444 050-1234567", "note", "a***@***.com **** **** **** **** ***-***-****"), ("דנה כהן", "שם_לקוח", "***"), ("Dana Cohen", "lname", "***"), ("Dana Cohen", "first", "***"),
        ("+1 (212) 555-0100", "נייד", "***-***-****"), ("דנה כהן", "עיר", "דנה כהן"), (None, "name", None), ("", "name", ""),
    ]:
        assert value(T.mask_pii(text(said), column)) == want
    for said, want in [
        ("k IN ((1, 2), (3, 4)) and n = 5", "k IN ((<N>, <N>), (<N>, <N>)) and n = <N>"), ("in" + " " * 30 + "(1)", "in" + " " * 30 + "(<N>)"), ("w=1e5", "w=<N>"), ("w=1.5E-3 or v=.5", "w=<N> or v=<N>"),
        ("in (f(g(1)), t1) and x in (2", "in (f(g(<N>)), t1) and x in (<N>"), ("a = '" + "x''" * 50_000 + "'", "a = '<REDACTED>'"),
    ]:
        assert value(T.redact(text(said))) == want


def test_rules_by_words(value):
    of = lambda f, *names: [value(f(text(n))) for n in names]
    assert of(rules.display_type, "order_id", "ID", "Paid_At", "is_x", "this_is", "x") == ["id", "id", "timestamp", "boolean-like", "text", "text"]
    assert of(rules.sql_type, "id", "idx", "net_amount", None) == ["int", "nvarchar", "money", "nvarchar"]
    domain = lambda s, t: value(rules.business_domain(text(s), text(t)))
    assert [domain(*x) for x in (("prod_finance", "t"), ("sales", "customer_x"), ("sales", "x"), ("legacy_a", "x"), ("q", "shipment"), ("q", "x"), (None, None))] == ["Finance", "CRM", "Operations", "Legacy Core", "Logistics", "Operations", "Operations"]


def test_concepts_in_every_kind(spark):
    df = spark.createDataFrame([("t1", "Café NOIR", 1), ("t2", None, 2), (None, "café", 3), ("t1", "Café NOIR", 1), ("t3", "", 4)], "item string, note string, n int")
    things = concepts.blobs(df, "table", table_key="item", texts=("note", "n")).union(concepts.blobs(df, "column", "review", "item", "note"))
    got = rows(concepts.search(things, {"drink": ["café", "", None], "dark": ["noir", "T2"], "none": []}))
    assert got == sorted([("drink", "column", "review", "", "café", ""), ("drink", "table", "", "", "", ""), ("dark", "table", "", "t1", "", ""), ("dark", "table", "", "t2", "", ""), ("dark", "column", "review", "t1", "Café NOIR", ""), ("dark", "column", "review", "t2", "", "")], key=str)
    long = concepts.blobs(spark.createDataFrame([("x" * 200_000 + "needle",)], "item string"), "table", legacy="item")
    assert concepts.search(long, {"q": ["NEEDLE"]}).count() == 1 and concepts.search(things, {}).count() == 0 and concepts.search(things.limit(0), {"q": ["a"]}).count() == 0


def test_shapes_of_json(spark):
    docs = [(1, '{"a": 1, "b": [1]}'), (2, None), (3, "["), (4, "[1]"), (5, "{}"), (6, '{"a": "x", "b": {}}'), (7, '{"a": null, "b": null}'), (None, "nope"), (2, "")]
    df = spark.createDataFrame(docs, "id int, t string")
    got = {(r.field, r.state): (r.n, r.first) for r in quality.json_shapes(df, "id", "t", {"$.a": "int", "$.b": "ARRAY"}, samples=2).collect()}
    assert got == {("$", "not_json"): (4, [2, 2]), ("$", "wrong_root"): (1, [4]), ("$.a", "missing"): (2, [5, 7]), ("$.a", "wrong_type"): (1, [6]), ("$.b", "missing"): (2, [5, 7]), ("$.b", "wrong_shape"): (1, [6])}
    assert quality.json_shapes(df.limit(0), "id", "t", {"$.a": "int"}).count() == 0
    assert quality.json_shapes(df.where("id = 4"), "id", "t", {}, root="ARRAY").count() == 0


def test_audit_runs_are_there_once(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "x"), (2, None)], "item int, decision string"), str(tmp_path / "log")
    assert bundles.read_audit(spark, path, df.schema).count() == 0
    df.withColumn("run_id", F.lit("half")).write.json(f"{path}/entries/run=half")
    assert bundles.append_run(df, path, "a/b") and not bundles.append_run(df, path, "a/b") and bundles.append_run(df.limit(0), path, "empty") and bundles.append_run(df, path, "007")
    got = bundles.read_audit(spark, path, df.schema)
    assert rows(got.select("run_id", "item", "decision")) == [("007", 1, "x"), ("007", 2, None), ("a/b", 1, "x"), ("a/b", 2, None)]
    assert bundles.append_run(df, path, "half") and bundles.read_audit(spark, path, df.schema).where("run_id = 'half'").count() == 2


def test_runs_are_counted_while_they_are_written(spark):
    log = [(1, "SELECT a FROM s.t JOIN s.u ON 1 = 1", "P"), (2, None, "P"), (3, " -- FROM x", "P"), (4, "COMMIT", "P"), (5, "SELECT f(a FROM b) FROM", "P"), (6, "SELECT a FROM s.t", "T"), (7, "SELECT a FROM s.t", None)]
    df = spark.createDataFrame(log, "stmt int, sql string, env string")
    refs, seen = extract.ingest(df, F.col("env") == "P")
    assert rows(refs) == [(1, "s.t"), (1, "s.u")]
    assert seen == {"total": 7, "parsed": 1, "fallback": 1, "unparsed": 1, "skipped_empty": 2, "skipped_env_mismatch": 2, "references": 2}
    refs, seen = extract.ingest(df.limit(0), F.col("env") == "P")
    assert refs.count() == 0 and set(seen.values()) == {0}


def test_drift_between_versions(spark):
    old = spark.createDataFrame([(1, "SELECT a, sum(b) AS t FROM s.t"), (2, "SELECT a FROM s.t"), (3, None)], "stmt int, sql string")
    new = spark.createDataFrame([(1, "SELECT a, c t, d FROM s.t JOIN s.u ON 1 = 1"), (4, "SELECT * FROM s.v"), (3, "")], "stmt int, sql string")
    got = {r.stmt: tuple(r)[1:] for r in extract.drift(extract.signatures(old), extract.signatures(new)).collect()}
    assert got == {1: ("changed", ["s.u"], [], ["d"], []), 2: ("dropped", [], ["s.t"], [], ["a"]), 3: ("same", [], [], [], []), 4: ("new", ["s.v"], [], [], [])}
    assert extract.outputs("SELECT x.a, b AS c, f(d), e g FROM (SELECT h FROM s.t) x UNION SELECT i FROM s.u") == [("a",), ("c",), ("g",), ("i",)]


def test_table_search_and_citations(spark):
    df = spark.createDataFrame([("a.T", "X", "red", 0.5, 3), ("b", None, "green", None, 1), ("c", "at", None, 0.9, None), ("d", "at", "red", 0.5, 9)], "item string, domain string, queue string, confidence double, criticality int")
    ask = lambda *how, **more: [r.item for r in selection.table_search(df, *how, **more).collect()]
    assert ask() == ["a.T", "b", "c", "d"] and ask("A", ("item", "domain")) == ["a.T", "c", "d"] and ask("A", ("item",)) == ["a.T"] and ask(queues=["red"], sort="criticality", descending=True) == ["d", "a.T"]
    assert ask(least_confidence=0.5) == ["a.T", "c", "d"] and ask(most_criticality=3) == ["a.T", "b"] and ask(done=df.where("item = 'b'").union(df.limit(1))) == ["c", "d"] and ask(domain="X", most=1) == ["a.T"]
    assert selection.table_search(df.limit(0), "a").count() == 0
    m = spark.createDataFrame([("t", "B", "b", "exact", 0.98, "merged"), ("t", "a", "b", "blended", 0.8, "merged"), ("t", "a", "b", "blended", 0.8, "merged"), ("t", "z", None, "blended", 0.9, "merged"), ("t", "q", "b", "exact", 0.1, "trash")], "table_key string, name string, target string, strategy string, confidence double, bucket string")
    assert rows(mapping.citations(m)) == [("t", "b", "B→b: exact, 0.980000; a→b: blended, 0.800000")] and mapping.citations(m.limit(0)).count() == 0


def test_scopes_of_reports(spark):
    cards = spark.createDataFrame(
        [(1, "confirmed", "A", ["t", None, " "], 0.9), (2, "confirmed", "A", None, 0.9), (3, "Glossary_Source", "B", ["q"], 0.9), (4, "confirmed", "B", ["u", " t "], 0.9), (5, "confirmed", "A", ["t"], 0.1), (6, None, None, ["t"], None), (7, "review", "A", ["u"], 0.9)],
        "card int, kind string, domain string, tables array<string>, confidence double",
    )
    inventory = spark.createDataFrame([("t", "A", None), ("u", "B", "North"), ("u", "B", "North")], "table string, domain string, portfolio string")
    ask = lambda *how: sorted(r.card for r in reports.cards_by_scope(cards, inventory, *how).collect())
    assert ask(0.5, ["A"]) == [1, 2, 3, 4] and ask(0.5) == [1, 2, 3, 4, 7] and ask(0.5, ["B"], "South") == [3] and ask(0.5, ["B"], "North") == [3, 4, 7]
    assert ask(0.0, ["A"]) == [1, 2, 3, 4, 5, 6]
    assert reports.cards_by_scope(cards.limit(0), inventory, 0.0).count() == 0
    assert reports.in_domains(inventory, None).count() == 3 and reports.in_domains(inventory, ["A"]).count() == 1
    allowed = spark.createDataFrame([("t",), ("t",), (None,)], "table string")
    assert [reports.in_tables(inventory, a, "table").count() for a in (None, allowed, allowed.limit(0))] == [3, 1, 0]


def test_peers_firsts_and_pairs(spark):
    parts = [spark.createDataFrame(r, "item string, peer string, weight int") for r in ([("a", "x", 2), ("a", "y", 1), (None, "x", 9)], [("a", "y", 1), ("a", "z", 1), ("b", None, 3)])]
    assert rows(baskets.merge_peers(*parts, most=2)) == [("a", "x", 2), ("a", "y", 2)] and baskets.merge_peers(*parts, most=None).count() == 3 and baskets.merge_peers(parts[0].limit(0)).count() == 0
    df = spark.createDataFrame([("K", 1, "a"), ("k", 2, None), ("k", 2, "b"), (None, 5, "c"), (None, None, "d")], "name string, at int, v string")
    assert rows(baskets.first_per_key(df, F.lower("name"), ["at"])) == [("k", "k", 2, "b"), (None, None, 5, "c")]
    assert [r.v for r in baskets.first_per_key(df, F.lower("name"), ["at"], 1).collect()] == ["c"] and baskets.first_per_key(df, F.lower("name"), ["at"], newest=False).where("key = 'k'").first().v == "a"
    log = spark.createDataFrame([(1, "SELECT [סכום], Amount, [שם], x_id FROM s.t"), (2, "SELECT [סכום], amount, [שם], other FROM s.t"), (3, None)], "stmt int, sql string")
    catalog = spark.createDataFrame([("AMOUNT",), ("amount",), ("x_id",), (None,)], "col string")
    assert rows(extract.mined_pairs(log, catalog)) == [("סכום", "amount", 2)] and extract.mined_pairs(log.limit(0), catalog).count() == 0
    kept, seen = catalogs.of_schemas(log, ["S"])
    assert kept.count() == 2 and seen == {"kept": 2, "skipped": 1}
    scripts = spark.createDataFrame([(1, "USE x\nGO\nSELECT 1\nGO\nEXEC sp_who\n go \nCREATE DATABASE d\nGO\n"), (2, None)], "script int, text string")
    assert [r.sql for r in selection.batches(scripts).collect()] == ["SELECT 1"]


def test_long_lines_are_dead_letters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sql": "short"}\n\n' + '{"sql": "' + "x" * 100 + '"}\n')
    every = logs.all_lines(spark, str(tmp_path))
    assert every.count() == 2 and logs.lines(spark, str(tmp_path), longest=50).count() == 1 and logs.lines(spark, str(tmp_path), longest=None).count() == 2
    assert [(r.error_reason, len(r.original_payload), r.run_id) for r in logs.too_long(every, "ingest", "r", 50).collect()] == [("line over 50 characters", 111, "r")]
    one, two = spark.createDataFrame([("a", "c")], "text string, channel string"), spark.createDataFrame([("b", 1)], "text string, ts int")
    assert sorted((r.text, r.channel, r.origin) for r in logs.combined(one, two, labels=["x", "y"]).collect()) == [("a", "c", "x"), ("b", None, "y")]
