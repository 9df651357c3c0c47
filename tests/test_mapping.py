"""Name mapping against plain Python, and small cases of planning."""

import hashlib
from difflib import SequenceMatcher

import numpy as np
import pytest

from tallymill.functions import names as N
from tallymill.operators import mapping as M
from tallymill.operators import planning as P

F = pytest.importorskip("pyspark.sql.functions")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def vector(text):
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.Generator(np.random.PCG64(seed)).standard_normal(64)
    return v / np.linalg.norm(v)


def usage(spark, *names):
    return spark.createDataFrame([("t", n, 1, 0, 2) for n in names], "table_key string, name string, n_select long, n_where long, n_join long")


CATALOG = ["customer_id", "created_at", "status", "net_amount"]


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("t", c) for c in CATALOG], "table_key string, col string")


@pytest.fixture
def glossary(spark):
    return spark.createDataFrame([("סטטוס", "status"), ("gone", "absent")], "term string, target string")


def test_guesses_equal_plain_python(spark, catalog, glossary):
    names = ["customer_ids", "creatd_at", "zz", "net amnt", "flag_1"]
    got = {r["name"]: r for r in M.resolve_names(usage(spark, *names), catalog, glossary).collect()}
    for name in names:
        norm = name.replace(" ", "_")
        score = {c: min(1.0, 0.55 * float(vector(f"log column identifier: {name}") @ vector(f"DDL column canonical: {c}")) + 0.45 * SequenceMatcher(None, norm, c).ratio()) for c in CATALOG}
        best = min(CATALOG, key=lambda c: (-score[c], c))
        want = max(0.0, score[best] * (0.35 if name == "flag_1" else 1.0))
        assert got[name]["target"] == best and got[name]["confidence"] == pytest.approx(want, abs=2e-6)
        assert got[name]["bucket"] == ("merged" if want >= 0.8 else "review" if want >= 0.4 else "trash")


def test_glossary_then_equality_and_right_to_left_names(spark, catalog, glossary):
    got = {r["name"]: r for r in M.resolve_names(usage(spark, "סטטוס", "Customer ID", "gone", "שלום", None), catalog, glossary).collect()}
    assert None not in got
    assert (got["סטטוס"]["strategy"], got["סטטוס"]["confidence"], got["סטטוס"]["bucket"]) == ("glossary", 0.95, "merged")
    assert (got["Customer ID"]["strategy"], got["Customer ID"]["target"]) == ("exact", "customer_id")
    assert got["gone"]["strategy"] == "blended"
    assert got["שלום"]["bucket"] == "trash" and got["שלום"]["confidence"] <= 0.32


def test_peers_decide_for_ambiguous_names_only(spark):
    pairs = spark.createDataFrame([("t", "id", "a_id", 0.5), ("t", "id", "order_id", 0.45), ("t", "total", "x", 0.5), ("t", "total", "order_id", 0.45)], "table_key string, name string, col string, score double")
    peers = spark.createDataFrame([("t", "id", "order"), ("t", "total", "order")], "table_key string, name string, peer string")
    assert rows(M.best_candidate(pairs, peers)) == [("t", "id", "order_id", 0.45), ("t", "total", "x", 0.5)]
    assert rows(M.best_candidate(pairs)) == [("t", "id", "a_id", 0.5), ("t", "total", "x", 0.5)]


def test_empty_tables_give_empty_mappings(spark, catalog, glossary):
    none = M.resolve_names(usage(spark, "a").limit(0), catalog, glossary)
    assert none.count() == 0 and M.merged(none).count() == 0
    lost = M.resolve_names(usage(spark, "a"), catalog.limit(0), glossary).first()
    assert lost["target"] is None and lost["bucket"] == "trash"


def test_wide_tables_take_the_nearest_column(spark):
    import hashlib

    import numpy as np

    def vector(text):
        v = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little"))).standard_normal(N.DIMENSIONS)
        return v / np.linalg.norm(v)

    columns, asked = [f"c{i}" for i in range(12)] + ["total_amt"], ["total", "zz"]
    catalog = spark.createDataFrame([("t", c) for c in columns] + [("u", "total")], "table_key string, col string")
    names = spark.createDataFrame([("t", n) for n in asked], "table_key string, name string")
    want = {n: sorted((-float(vector(f"log column identifier observed: {n}") @ vector(f"DDL column canonical identifier: {c}")), c) for c in columns) for n in asked}
    got = M.nearest_names(names, catalog, 3).collect()
    assert sorted((r["name"], r["col"]) for r in got) == sorted((n, c) for n in asked for _, c in want[n][:3])
    wide = {r["name"]: r for r in M.blended(names, catalog, pairwise=10).collect()}
    assert len(wide) == 2 and all(wide[n]["col"] == want[n][0][1] for n in asked)
    assert abs(wide["total"]["score"] - (0.55 * -want["total"][0][0] + 0.45 * 10 / 14)) < 1e-9
    assert M.blended(names, catalog).count() == 26 and M.nearest_names(names.limit(0), catalog).count() == 0


def test_names_in_two_normal_forms_are_one(spark):
    catalog = spark.createDataFrame([("t", "caf\u00e9 no")], "table_key string, col string")
    names = spark.createDataFrame([("t", "cafe\u0301  no")], "table_key string, name string")
    assert rows(M.by_equality(names, catalog)) == [("t", "cafe\u0301  no", "caf\u00e9 no")]
    assert spark.range(1).select(N.transliterate(F.lit("\uff21b\ufb01"))).first()[0] == "abfi"


def test_transliteration(spark):
    df = spark.createDataFrame([("שם לקוח",), ("A-b.c",), ("!!",), (None,), ("חצי",)], "n string")
    assert [r[0] for r in df.select(N.transliterate(F.col("n"))).collect()] == ["shm_lqvkh", "a_b_c", "col", "col", "khtsy"]


def test_rename_order_is_registry_glossary_spelling(spark):
    names = spark.createDataFrame([("a",), ("b",), ("אב",), (" ",)], "name string")
    registry = spark.createDataFrame([("a", "kept")], "name string, alias string")
    glossary = spark.createDataFrame([("b", "Net Amount")], "term string, target string")
    assert rows(M.rename_mapping(names, registry, glossary)) == sorted([("a", "kept", "transliteration", 1.0, False), ("b", "net_amount", "glossary", 1.0, False), ("אב", "ab", "transliteration", 0.55, True)], key=str)


def test_waiting_waves_block_later_ones(spark):
    df = spark.createDataFrame([(1, "SUCCESS"), (2, "PARTIAL"), (2, "HITL_REQUIRED"), (3, "SUCCESS"), (4, None)], "w int, s string")
    assert rows(P.wave_status(df, "w", F.col("s"))) == [(1, 1, "SUCCESS", True, False), (2, 2, "HITL_REQUIRED", False, False), (3, 1, "SUCCESS", True, True), (4, 1, "PENDING", False, True)]
    assert [r["blocked"] for r in P.wave_status(df, "w", F.col("s"), bypass=2).orderBy("wave").collect()] == [False, False, False, False]


def test_declared_keys_come_before_inferred_ones(spark):
    cols = spark.createDataFrame([(1, "customers", "customer_id", True), (2, "orders", "order_id", True), (3, "orders", "Customer_ID", False), (4, "lines", "order_id", False)], "pos int, table_key string, col string, is_key boolean")
    told = spark.createDataFrame([("lines", "orders", "order_ref")], "child string, parent string, col string")
    assert rows(P.foreign_keys(cols, told)) == [("lines", "orders", "order_ref"), ("orders", "customers", "Customer_ID")]


def test_gap_wave_needs_room(spark):
    planned, missing = spark.createDataFrame([("a", 1)], "item string, wave int"), spark.createDataFrame([("z",), ("y",)], "item string")
    assert rows(P.with_gap_wave(planned, missing, 1, 2)) == [("a", 1, False), ("y", 2, True)]
    assert rows(P.with_gap_wave(planned, missing, 1, 1)) == [("a", 1, False)]
    assert rows(P.with_gap_wave(planned.limit(0), missing, 2, 1)) == [("y", 1, True), ("z", 1, True)]


def test_whole_numbers_only(spark):
    df = spark.createDataFrame([("m", '{"rows_affected": 3}'), ("n", '{"rows": "x"}'), ("o", "{}"), ("", '{"rows": 1}'), ("p", None)], "model string, response string")
    assert rows(P.run_rows(df)) == [("m", 3), ("n", None), ("o", None), ("p", None)]
