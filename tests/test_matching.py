"""Substring joins, leader clusters, running states, incremental loads and scoped references against plain Python, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import extract, incremental, leaders, substring
from tallymill.streaming import counts, status


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Substring joins


def words(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abAé ü😀") for _ in range(rnd.randrange(0, most))) for _ in range(n)]


@pytest.mark.parametrize("salt_rows", [3, 50_000])
def test_substring_pairs_are_brute_force(spark, salt_rows):
    texts = [*words(1, 120, 12), None, "", "same", "same", "x" * 5000 + "needle" + "y" * 5000]
    names = [*words(2, 60, 5), None, "", "needle", "NEEDLE", "😀", "a"]
    t, n = (spark.createDataFrame([(x, 1) for x in v], "v string, text int") for v in (texts, names))
    want = sorted({(b.lower(), a.lower()) for a in texts if a for b in names if b and b.lower() in a.lower()})
    assert rows(substring.pairs(t, n, "v", "v", salt_rows=salt_rows)) == sorted(want, key=str)
    exact = sorted({(b, a) for a in texts if a for b in names if b and b in a}, key=str)
    assert rows(substring.pairs(t, n, "v", "v", fold=False, q=2)) == exact
    assert rows(substring.contained(t, n, "v", "v")) == sorted({(b,) for b, _ in want}, key=str)
    for a, b in ((t.where("false"), n), (t, n.where("false")), (t.where("v = ''"), n)):
        assert substring.pairs(a, b, "v", "v").count() == 0


def test_no_nested_loop_in_the_plan(spark):
    t = spark.createDataFrame([("abc",)], "v string")
    plan = substring.pairs(t, t, "v", "v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_peers_both_ways(spark):
    peers = spark.createDataFrame([("Id",), ("order_id_key",), (None,), ("zz",)], "peer string")
    columns = spark.createDataFrame([("order_id",), ("ID",), (None,)], "col string")
    assert rows(substring.near_peers(peers, columns)) == [("id", "id"), ("id", "order_id"), ("order_id_key", "id"), ("order_id_key", "order_id")]


# Leader clusters


def sequential(vectors, threshold):
    """Label of each (id, vector) and its leader, by the loop."""
    heads, out = [], []
    for i, v in vectors:
        v = np.array(v)
        norm = np.sqrt(sum(x * x for x in v))
        v = v / (norm if norm > 0 else 1)
        at = next((k for k, (_, h) in enumerate(heads) if len(h) == len(v) and len(v) and (h * v).sum() >= threshold), None)
        if at is None:
            at = len(heads)
            heads.append((i, v))
        out.append((i, f"cluster_{at}", heads[at][0], "Core" if at == 0 else "Rest"))
    return sorted(out, key=str)


@pytest.mark.parametrize("first", [4, 64, 2048])
def test_leaders_are_the_sequential_loop(spark, first):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((12, 6))
    data = [(i, (centres[rnd.integers(12)] + rnd.standard_normal(6) * rnd.choice([0.1, 0.4, 0.6])).tolist()) for i in range(400)]
    data += [(400, data[3][1]), (401, data[3][1]), (402, [0.0] * 6), (403, [0.0] * 6), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (406, [])]
    out = [(407, None), (408, [1.0, None]), (409, [float("nan")] * 6), (None, data[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data + out], "id long, vec array<double>, n int, leader int").repartition(5)
    want = sequential(data, 0.88)
    assert 20 < len({w[1] for w in want}) < 200
    assert rows(leaders.leader_clusters(df, "id", "vec", first=first, taxonomy={"cluster_0": "Core", "default": "Rest"})) == want
    assert leaders.leader_clusters(df.where("false"), "id", "vec").count() == 0


def test_leaders_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(leaders, "BLOCK", 50)
    rnd = np.random.default_rng(5)
    data = [(i, rnd.standard_normal(3).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "id long, vec array<double>")
    got = [r[:3] for r in rows(leaders.leader_clusters(df, "id", "vec", first=40))]
    assert got == [w[:3] for w in sequential(data, 0.88)]


# Running status

START = datetime(2024, 1, 1)
KINDS = ["start", "work", "done", None]


def events(n=300, jobs=15):
    rnd = random.Random(4)
    out = [(i, None if i % 41 == 0 else f"j{rnd.randrange(jobs)}", None if i % 53 == 0 else START + timedelta(minutes=rnd.randrange(60)), rnd.choice(KINDS)) for i in range(n)]
    return out + out[:20] + [(None, "j0", START + timedelta(hours=3), "work"), (7000, "j0", START + timedelta(hours=3), "done"), (None, "alone", START, "x")]


def batches(spark, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, job string, ts timestamp, status string").coalesce(1).write.mode("append").parquet(folder)


def brute_latest(data):
    out = {}
    for i, job, ts, s in data:
        if job is not None and ts is not None:
            out.setdefault(job, []).append((ts, -(2**63) if i is None else i, s))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_status_of_a_stream_is_the_batch_answer(spark, tmp_path, parts):
    data = events()
    random.Random(parts).shuffle(data)
    batches(spark, str(tmp_path), [data[k::parts] for k in range(parts)])
    want = {job: (*max(v, key=lambda e: e[:2]), len(v)) for job, v in brute_latest(data).items()}
    stream = lambda: counts.read_files(spark, str(tmp_path), 1)
    got = {r.job: (r.ts, -(2**63) if r.id is None else r.id, r.status, r.n) for r in counts.drain(status.latest(stream(), "job", "ts", "id", "status"), ["job"]).collect()}
    ties = lambda d: {j: v[:2] for j, v in d.items()}
    assert ties(got) == ties(want) and {j: v[3] for j, v in got.items()} == {j: v[3] for j, v in want.items()}
    state = counts.drain(status.running(stream(), "job", "ts", "id", "status", ("done",), "3650 days", 1000), ["job"]).collect()
    assert {r.job: (r.ts, -(2**63) if r.id is None else r.id) for r in state} == ties(want) and all(r.open for r in state)


def test_finished_jobs_leave_the_state_by_a_timer(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    folder = str(tmp_path)
    seen = []
    for part in ([(1, "a", at(0), "start"), (2, "b", at(0), "start"), (3, "a", at(1), "done")], [(4, "b", at(60), "work")], [(5, "b", at(120), "work"), (6, "a", at(2), "start")], [(7, "c", at(180), "done")], [(8, "a", at(200), "start")]):
        batches(spark, folder, [part])
    out = status.running(counts.read_files(spark, folder, 1), "job", "ts", "id", "status", ("done",), "10 minutes", 300_000)
    got = counts.drain(out, ["job"]).collect()
    state = {r.job: (r.id, r.status, r.open) for r in got}
    assert state["b"] == (5, "work", True) and state["a"] == (8, "start", True) and state["c"][:2] == (7, "done")
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}-again").foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert any(r.job == "a" and not r.open and r.id == 3 for r in seen)  # dropped once, then opened anew; event 6 came too late
    assert not any(r.id == 6 for r in seen)


# Incremental loads


def test_the_ordering_column_is_inferred():
    of = incremental.ordering_column
    assert of(["id", "loaded_at", "event_ts"]) == ("event_ts", "event-time") and of(["id", "load_at", "x_dt"]) == ("load_at", "file-time")
    assert of(["a", "b_dt"]) == ("b_dt", "file-time") and of(["a", "b"]) == ("a", "file-time") and of([" ", ""]) == ("id", "file-time") and of([]) == ("id", "file-time")
    for bad in (None, "", " ", [], [" "]):
        with pytest.raises(ValueError):
            incremental.unique_key(bad)
    assert incremental.unique_key("k") == ["k"] and incremental.unique_key(["k", "m"]) == ["k", "m"]


SOURCE = "k int, m string, ts timestamp, v string, w double"


def source_rows(n=200):
    rnd = random.Random(8)
    out = [(rnd.randrange(40) if rnd.random() > 0.1 else None, rnd.choice(["a", "b", None]), START + timedelta(minutes=i // 3), rnd.choice(["x", None, "y"]), rnd.choice([1.0, None])) for i in range(n)]
    return out + out[-5:] + [(1, "a", None, "never", 1.0)]


def newest_rows(data):
    order = lambda r: (r[2], r[3] is not None, r[3] or "", r[4] is not None, r[4] or 0)
    best = {}
    for r in data:
        if r[2] is not None and (r[:2] not in best or order(r) > order(best[r[:2]])):
            best[r[:2]] = r
    return sorted(best.values(), key=str)


def test_loads_and_replays_equal_one_full_load(spark, tmp_path):
    data = source_rows()
    df = spark.createDataFrame(data, SOURCE)
    cut = F.lit(START + timedelta(minutes=30))
    path = str(tmp_path / "t")
    assert incremental.read_target(spark, path) is None
    assert incremental.load(df.where("false"), path, ["k", "m"], "ts") == 0
    first = incremental.load(df.where(F.col("ts") <= cut), path, ["k", "m"], "ts", buckets=5)
    assert first > 0 and incremental.load(df.where(F.col("ts") <= cut), path, ["k", "m"], "ts", buckets=5) == 0
    assert incremental.load(df, path, ["k", "m"], "ts", buckets=5) > 0 and incremental.load(df, path, ["k", "m"], "ts", buckets=5) == 0
    assert rows(incremental.read_target(spark, path).select(*df.columns)) == newest_rows(data)
    whole = str(tmp_path / "w")
    incremental.load(df, whole, ["k", "m"], "ts", buckets=5)
    assert rows(incremental.read_target(spark, whole).select(*df.columns)) == newest_rows(data)


def test_only_folders_of_new_keys_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(START).alias("ts"))
    incremental.load(df, path, "k", "ts", buckets=20)
    files = {f for f in incremental.read_target(spark, path).inputFiles()}
    incremental.load(df.where("k in (3, 4)").withColumn("ts", F.lit(START + timedelta(days=1))), path, "k", "ts", buckets=20)
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert len(files) == 20 and len(files - after) <= 2 and spark.read.parquet(path).count() == 1000


def test_streamed_batches_in_any_order(spark, tmp_path):
    data = [r for r in source_rows() if r[2] is not None]
    random.Random(2).shuffle(data)
    for k in range(4):
        spark.createDataFrame(data[k::4], SOURCE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for run in ("one", "two"):  # the second run merges all batches again
        stream = counts.read_files(spark, str(tmp_path / "in"), 1)
        incremental.load_stream(stream, str(tmp_path / "t"), str(tmp_path / run), ["k", "m"], "ts", buckets=3)
        assert rows(incremental.read_target(spark, str(tmp_path / "t")).select("k", "m", "ts", "v", "w")) == newest_rows(data)


# References in scopes

STATEMENTS = {
    "SELECT e.a FROM (SELECT a FROM s.t) e": (["s.t"], [("select", "s.t", "a")] * 2),
    "SELECT d.b FROM s.t JOIN (SELECT b FROM s.u) AS d ON d.b = t.k, s.v": (["s.t", "s.u", "s.v"], [("select", "s.u", "b"), ("select", "s.u", "b"), ("join_on", "s.u", "b"), ("join_on", "s.t", "k")]),
    "SELECT EXTRACT(YEAR FROM dt), TRIM(BOTH ' ' FROM n) FROM s.t WHERE a IS NOT DISTINCT FROM b": (["s.t"], [("select", "s.t", "dt"), ("select", "s.t", "n"), ("where", "s.t", "a"), ("where", "s.t", "b")]),
    "WITH c(x) AS (SELECT y FROM s.t) SELECT x FROM c, LATERAL f(c.x) g": (["s.t"], [("select", "s.t", "y"), ("select", "s.t", "x")]),
    "MERGE INTO s.t USING s.u ON t.id = u.id WHEN MATCHED THEN UPDATE SET a = u.b": (["s.t", "s.u"], [("join_on", "s.t", "id"), ("join_on", "s.u", "id"), ("where", "s.t", "a"), ("where", "s.u", "b")]),
    "SELECT a FROM s.t UNION SELECT b FROM s.u; SELECT c FROM s.v": (["s.t", "s.u", "s.v"], [("select", "s.t", "a"), ("select", "s.u", "b"), ("select", "s.v", "c")]),
    "SELECT [My Col], a::int, arr[i] FROM [dbo].[T a] q": (["dbo.t a"], [("select", "dbo.t a", "my col"), ("select", "dbo.t a", "a"), ("select", "dbo.t a", "arr"), ("select", "dbo.t a", "i")]),
    "SELECT (SELECT max(q) FROM s.u WHERE u.k = t.k) FROM s.t t WHERE CAST(z AS date) > @p": (["s.u", "s.t"], [("select", "s.u", "q"), ("where", "s.u", "k"), ("where", "s.t", "k"), ("where", "s.t", "z")]),
    "SELECT a FROM (s.t JOIN s.u ON t.k = u.k) JOIN s.v USING (k)": (["s.t", "s.u", "s.v"], [("select", "s.t", "a"), ("join_on", "s.t", "k"), ("join_on", "s.u", "k"), ("join_on", "s.t", "k")]),
    "SELECT x.a FROM (VALUES (1, 2)) x(a, b), s.t WITH (NOLOCK)": (["s.t"], [("select", None, "a")]),
    "INSERT INTO s.t (a) SELECT b FROM s.u WHERE c IN (SELECT d FROM s.v)": (["s.t", "s.u", "s.v"], [("select", "s.t", "a"), ("select", "s.u", "b"), ("where", "s.u", "c"), ("select", "s.v", "d")]),
}


@pytest.mark.parametrize("sql", STATEMENTS)
def test_references_in_scopes(sql):
    tables, columns = extract.references(sql)
    assert [t for t, _ in tables] == STATEMENTS[sql][0] and columns == STATEMENTS[sql][1]


def test_broken_statements_end(spark):
    for text in ("(((", ")))", "with a as (", "select a from (select b from", "insert into", "merge into x using", "a.b.c.d", "'open", "select \"", ";;", "union", "as as ( select"):
        extract.references(text)


def test_shapes_keep_references_and_are_read_once(spark, monkeypatch):
    texts = list(STATEMENTS) + ["SELECT a1, 'it''s' b FROM s.t2 -- from x.y\nWHERE c = 1.5e3 AND \"d 7\" = 'q' /* from z */", None, "", "   ", "-- only"]
    texts += [f"SELECT a FROM s.t WHERE b = {i} AND c = 'v{i}''x'" for i in range(50)]
    log = spark.createDataFrame(list(enumerate(texts)), "stmt int, sql string")
    shapes = {r.stmt: r.shape for r in log.select("stmt", extract.shape(F.col("sql")).alias("shape")).collect()}
    for i, text in enumerate(texts):
        assert extract.references(shapes[i]) == extract.references(text), text
    assert len({shapes[i] for i in range(len(texts) - 50, len(texts))}) == 1
    want = Counter((i, p, *c) for i, t in enumerate(texts) for p, c in enumerate(extract.references(t)[1]))
    assert Counter(map(tuple, extract.column_refs(log).collect())) == want
    want = Counter((i, p, *c) for i, t in enumerate(texts) for p, c in enumerate(extract.references(t)[0]))
    assert Counter(map(tuple, extract.table_refs(log).collect())) == want
    assert extract.table_refs(log.where("false")).count() == 0
    long = spark.createDataFrame([(1, "SELECT a FROM s.t WHERE b = '" + "x''" * 200_000 + "'"), (2, "(" * 20_000 + "SELECT a FROM s.t" + ")" * 20_000)], "stmt int, sql string")
    assert {r.table_key for r in extract.table_refs(long).collect()} == {"s.t"}


def test_leaders_meet_rows_in_few_blocks():
    assert leaders._blocks(0, 64) == leaders._blocks(2048, 64) == 1 and leaders._blocks(4096, 64) == 2
    assert leaders._blocks(200_000, 64) == leaders._blocks(500_000, 64) == 16 and leaders._blocks(500_000, 4096) == 245


def test_every_two_blocks_of_a_prefix_meet_once(spark, monkeypatch):
    import random

    rnd = random.Random(7)
    monkeypatch.setattr(leaders, "BLOCK", 8)
    data = [(n, 2, [1.0, 0.0] if rnd.random() < 0.5 else [0.0, 1.0]) for n in range(1, 41)]
    df = spark.createDataFrame(data, "n bigint, dim int, vec array<double>")
    got = [(r.a, r.b) for r in leaders._tiles(df, df, 40, 40, 0.88, False).collect()]
    want = [(a, b) for a, _, v in data for b, _, w in data if a < b and v == w]
    assert sorted(got) == sorted(want)
