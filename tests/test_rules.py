"""Small fixtures for rules by name, anomaly flags and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import rules as R
from tallymill.sources import bundles as U


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def first(spark, values, schema, column):
    return [r[0] for r in spark.createDataFrame(values, schema).select(column).collect()]


def test_types_by_name(spark):
    names = [(n,) for n in ("ID", "order_id", "unit_price", "created_at", "state", "currency", "is_open", "note", None)]
    assert first(spark, names, "n string", R.display_type(F.col("n"))) == ["id", "id", "numeric", "timestamp", "status/text", "currency/text", "boolean-like", "text", "text"]
    assert first(spark, names, "n string", R.sql_type(F.col("n"))) == ["int", "int", "money", "nvarchar", "nvarchar", "nvarchar", "nvarchar", "nvarchar", "nvarchar"]


def test_domains_in_order_of_rules(spark):
    keys = [("junk", "invoice"), ("app", "לקוחות"), ("prod_finance", "orders"), ("sales", "order_lines"), ("PROD_SALES", "Customers"), ("x", "stock"), ("x", "leads"), ("x", "Promo"), ("x", "returns"), (None, None), ("legacy_a", "invoice")]
    assert first(spark, keys, "s string, t string", R.business_domain(F.col("s"), F.col("t"))) == ["Technical Debt", "Legacy Core", "Finance", "Operations", "CRM", "Logistics", "CRM", "Marketing", "Analytics", "Operations", "Legacy Core"]
    effort = R.migration_effort(F.col("s"), F.col("t"), R.business_domain(F.col("s"), F.col("t")))
    assert first(spark, keys, "s string, t string", effort) == [52, 40, 26, 18, 18, 26, 26, 26, 26, 26, 40]


def test_flags_of_each_kind(spark):
    wide = [("w", f"c{i}", "int") for i in range(30)]
    cols = wide + [(f"n{k}", f"x{i}", "int") for k in range(10) for i in range(10)] + [("b", "Blob", "NTEXT"), ("b", "a_b", "INT"), ("m", "a_b", "varchar")]
    items = [("w", "d"), *((f"n{k}", "d") for k in range(10)), ("b", "e"), ("m", "e"), ("none", "f")]
    got = R.anomaly_flags(
        spark.createDataFrame(items, "item string, domain string"),
        spark.createDataFrame(cols, "item string, col string, type string"),
        spark.createDataFrame([("w", 10, 6), ("b", 10, 5), ("m", 0, 0)], "item string, cells int, nulls int"),
        spark.createDataFrame([("m", "q", "r"), ("zz", "q", "r")], "item string, legacy string, target string"),
        spark.createDataFrame([(i,) for i, _ in items if i != "none"], "item string"),
    )
    found = {(r["item"], r["name"]) for r in got.collect()}
    skipped = {(i, "null_rate_check_skipped") for i, _ in items if i not in ("w", "b")}
    assert found == skipped | {("w", "column_count_outlier"), ("w", "high_null_rate"), ("b", "unsupported_blob_type"), ("b", "cluster_type_inconsistency"), ("m", "cluster_type_inconsistency"), ("b", "naming_entropy"), ("m", "hitl_rejected_mapping"), ("none", "outside_manifest_scope")}
    assert {r["reason"] for r in got.collect() if r["name"] == "cluster_type_inconsistency"} == {"Column a_b: INT here, VARCHAR in m", "Column a_b: VARCHAR here, INT in b"}


def test_flags_of_no_items(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert R.anomaly_flags(e("item int, domain string"), e("item int, col string, type string"), e("item int, cells int, nulls int"), e("item int, legacy string, target string"), e("item int")).collect() == []


def test_samples_are_masked_and_clamped(spark):
    df = spark.createDataFrame([(i, "ann@x.org") for i in range(20)], "k int, mail string")
    assert rows(R.masked_sample(df, "k", 99)) == sorted([(i, "a***@***.org") for i in range(10)], key=str)
    assert R.masked_sample(df, "k", 0).count() == 1


def test_equal_identities_share_the_first_label(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "x"), (5, "a B"), (6, None), (7, "")], "k int, t string")
    assert rows(R.identity_clusters(df, F.col("t"), "k", {"cluster_3": "Core"})) == sorted([(3, "cluster_3", "Core"), (1, "cluster_1", ""), (5, "cluster_3", "Core"), (6, "cluster_6", ""), (7, "cluster_6", "")], key=str)


def test_profile_spells_hebrew_names(spark):
    cat = spark.createDataFrame([("t", "שם"), ("t", "a_id")], "table_key string, col string")
    used = spark.createDataFrame([("t", "A_ID"), ("t", "z")], "table_key string, col string")
    assert rows(R.table_profile(cat, used)) == sorted([("t", "שם", True, False, "text", "shm"), ("t", "a_id", True, True, "id", None), ("t", "z", False, True, "text", None)], key=str)


def test_decisions_skip_invalid_texts(spark):
    df = spark.createDataFrame([('{"decisions": {"s": {"action": "approve"}}}',), ("{",), (None,), ("{}",)], "value string")
    assert rows(U.review_decisions(df)) == [("s", "approve")]


def test_audit_names_the_first_flag(spark, tmp_path):
    scored = spark.createDataFrame([(1, "approve", 90, "score", "c", "a"), (2, "reject", 10, "score", "c", "a")], "item int, decision string, confidence int, reason string, contract string, approver string")
    flags = spark.createDataFrame([(1, "INFO", "a", "i"), (1, "BLOCK", "z", "b")], "item int, level string, name string, reason string")
    out = U.audit_rows(scored, flags)
    assert {r["item"]: (len(r["flags"]), r["primary_reason"]) for r in out.collect()} == {1: (2, "b"), 2: (0, "score")}
    U.append_audit(out, str(tmp_path / "a"))
    U.append_audit(out, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4


def test_models_of_a_manifest(spark):
    text = '{"nodes": {"m.a": {"resource_type": "model", "name": "a", "schema": "s", "config": {"unique_key": ["x", "y"]}, "columns": {"q": {}}}, "t": {"resource_type": "test", "name": "b"}, "m.c": {"resource_type": "model", "name": "c", "alias": "d", "config": {"materialized": "table", "unique_key": "k"}}}}'
    got = U.model_nodes(spark.createDataFrame([(text,), ("[",), (None,)], "value string"))
    assert rows(got) == [("a", "s.a", "view", ["q"], ["x", "y"], None), ("c", "d", "table", [], ["k"], None)]


def test_bundle_and_extraction_round_trips(spark, tmp_path):
    path = str(tmp_path)
    U.write_bundle({"a": spark.range(3), "b": spark.range(2)}, path)
    assert {k: v.count() for k, v in U.read_bundle(spark, path, ["a", "b"]).items()} == {"a": 3, "b": 2}
    cat = spark.createDataFrame([("s", "t", "c", "int"), ("s", "t", "d", None), ("r", "t", "c", "int")], "schema string, table string, col string, type string")
    U.write_extraction(cat, spark.createDataFrame([("prod", "x", "SELECT 1")], "env string, dialect string, sql string"), path + "/e")
    assert rows(U.read_catalog(spark, path + "/e")) == rows(cat)
