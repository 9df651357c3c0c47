"""Sharding, ranked search and the filter audit against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallymill.llm import audit, lexical, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, shard string, row int, part string, term string, `a.b` int"


def documents(seed=3, n=150):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdéüßX0") for _ in range(rnd.randrange(1, 4))) for _ in range(200)]
    out = []
    for i in range(n):
        t = " ".join(rnd.choice(vocab[: rnd.choice([5, 40, 200])]) for _ in range(rnd.choice([0, 1, 5, 60, 250, 300])))
        if i % 10 == 3:
            t = out[-1][1]
        if i % 7 == 2:
            t = f"{t} $\t{i}"
        out.append((i if i % 13 else None, None if i % 17 == 0 else t, [None, "", "en", "fr"][i % 4], "x", 1, None, "t", None))
    out += [(507, "same Row twice", "en", "a", 3, None, None, None)] * 2
    out += [(507, "Another text of that id " * 60, "en", None, None, None, None, 1), (500, "W w " * 10_000, "de", "a", 1, "", "", 0), (501, "", None, None, None, None, None, None)]
    return out + [(None, None, None, None, None, None, None, None)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


# Sharding


def jump(key, n):
    """The published function."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def key(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def test_shards_are_the_published_function(spark, docs):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(documents())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(key(i), 16), jump(key(i), 17)) for i, t, *_ in documents())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    for s in range(16):
        mine = sorted((r.slot, r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in rows if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert sharding.assign(docs.where("false")).count() == 0
    assert sharding.assign(docs.repartition(7)).exceptAll(sharding.assign(docs)).count() == 0


def test_walks_longer_than_a_fold_and_many_shards(spark, monkeypatch):
    ids = spark.range(300).selectExpr("cast(id * 4294967296 as string) as doc_id")
    for steps in (2, 48):
        monkeypatch.setattr(sharding, "STEPS", steps)
        for n, m in ((1, 1), (1, 200), (60, 1000)):
            got = {r[0]: (r[1], r[2]) for r in sharding.walked(ids, "doc_id", n, m).select("doc_id", "shard", "grown_shard").collect()}
            assert got == {i: (jump(key(i), n), jump(key(i), m)) for i in got} and len(got) == 300


def test_only_the_needed_share_moves_into_new_shards(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    away = sharding.moved(ids, 16, 20)
    assert away.where("to_shard < 16 or from_shard > 15").count() == 0
    assert abs(away.count() / 20_000 - 4 / 20) < 0.02
    sizes = [r["count"] for r in sharding.place(ids, 16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.15 * 20_000 / 16
    with pytest.raises(ValueError):
        sharding.moved(ids, 20, 16)


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    clean = docs.drop("shard")
    sharding.write(clean, str(tmp_path / "out"), 5, file_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").select(*(f"`{c}`" for c in clean.columns)).exceptAll(clean).count() == 0 and back.count() == clean.count()
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == {(i, jump(key(i), 5)) for i, *_ in documents()}
    with pytest.raises(ValueError):
        sharding.place(docs)


# Ranked search


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(rows, items, k):
    found = [(r[0], collections.Counter(terms(r[1]))) for r in rows]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def queries(rows):
    texts = [r[1] for r in rows if r[1]]
    return [(1, texts[3]), (2, None), (3, "!!"), (None, texts[5][:40]), (4, texts[7] + " ÉÜ nowhere"), (4, "a a a b"), (5, texts[0])] + [(10 + i, t[:200]) for i, t in enumerate(texts[10:40])]


@pytest.mark.parametrize("short", [0.0, 0.1, 1.0])
def test_search_is_brute_force_whatever_counts_as_short(spark, docs, short, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 8)
    items = spark.createDataFrame(queries(documents()), "item_id int, text string")
    lists = lexical.index(docs, segment_bytes=5_000)
    assert lists.where("term is null").count() > 5
    got = lexical.search(lists, items, k=7, short=short).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(documents(), queries(documents()), 7)
    assert lexical.search(lists, items.where("false")).count() == 0
    assert lexical.search(lexical.index(docs.where("false")), items).count() == 0


def test_windows_and_lists_are_skipped():
    rnd = np.random.default_rng(4)
    edges = np.append(np.arange(0, 6000, 100), 6000)
    its, dense = [], np.zeros(6000, np.int64)
    for size, top in ((30, 900), (2000, 50), (4000, 20), (6000, 5)):
        docs = np.sort(rnd.choice(6000, size, replace=False))
        adds = rnd.integers(1, top, size)
        dense[docs] += 3 * adds
        its.append((3, lexical.Iterator(docs, adds, edges)))
    read = []
    for _, it in its:
        it.window, inner = (lambda w, it=it, f=it.window: (read.append((id(it), w)), f(w))[1]), it.window
    docs, scores = lexical.best_documents(its, edges, 0, 10)
    order = np.lexsort((docs, -scores))
    want = np.lexsort((np.arange(6000), -dense))[:10]
    assert docs[order].tolist() == want.tolist() and scores[order].tolist() == dense[want].tolist()
    assert len(read) < 0.6 * 4 * 60
    assert len(lexical.best_documents(its, edges, int(dense.max()) + 1, 10)[0]) == 0


def test_string_ids_and_ties(spark):
    rows = [(c, "same words here") for c in "zyxwv"] + [(None, "same words here"), ("a", "other")]
    lists = lexical.index(spark.createDataFrame(rows, "doc_id string, text string"))
    got = lexical.search(lists, spark.createDataFrame([(1, "Same")], "item_id int, text string"), k=9)
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == list(enumerate([*"vwxyz", None], 1))


# Filter audit

LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(507, 1, 1), (507, 0, 0), (None, 1, 1), (9999, 1, 1), (6, None, None)]


def failing(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        tests["E"] = t in least and (i is None or i > least[t])
        out.append({f for f, x in tests.items() if x})
    return out


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, taken = {}, collections.Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failing(rows)) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                before = [f for _, f in mine if name in f and f & set(order[: step - 1])]
                left = [(i, f) for i, f in left if name not in f]
                out[part, order, step] = (len(left), len(gone), len(before), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                taken[part, name] += len(gone)
    return sorted((*k, *v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_is_brute_force(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit(docs, labels).collect()))
    assert got == brute_audit(documents(), LABELS) and len(got) == 4 * 600
    assert audit.audit(docs.where("false"), labels).count() == 0
    assert sorted(map(tuple, audit.audit(docs, labels.where("false")).collect())) == brute_audit(documents(), [])


def test_trace_agrees_with_the_audit(spark, docs):
    rows = audit.facts(docs)
    tables = audit.relations(rows)
    assert [set(r) for r in failing(documents())] == [{f for f in "ABCDE" if f in x} for x in _fails(rows, tables)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    whole = {(r.part, r.filter_order, r.step): r for r in audit.audit(docs, labels).collect()}
    for order in ("ABCDE", "EDCBA", "CABED"):
        seen = collections.Counter((r.part, r.step, r.outcome) for r in audit.trace(rows, tables, order).collect())
        for part in ("", "en", "fr", "de"):
            assert seen[part, None, "kept"] == whole[part, order, 5].kept
            assert all(seen[part, s, "removed"] == whole[part, order, s].removed and seen[part, s, "redundant"] == whole[part, order, s].redundant for s in range(1, 6))


def _fails(rows, tables):
    at = collections.defaultdict(set)
    for name, ids in tables.items():
        for r in ids.collect():
            at[r.row].add(name)
    return [at[r.row] for r in rows.orderBy("row").collect()]
