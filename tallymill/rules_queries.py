"""Queries of rules by name, anomaly flags, profiles and bundles, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping_queries import CATALOG, USAGE, part_catalog, part_usage
from .operators import rules as R
from .plans.scratch import scratch_dir
from .register import query, read
from .registry import supplier_edges, supplier_inventory
from .sources import bundles as U


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


NAMES = "n AS (SELECT p_partkey, concat(split_part(p_name, ' ', 1), ['_id', '_total', '_date', 'Status', '_currency', '_flag', '_at', 'TaxRate', ''][1 + p_partkey % 9]) AS name FROM part)"


def part_names(spark, sf_dir) -> DataFrame:
    ends = F.array(*map(F.lit, ("_id", "_total", "_date", "Status", "_currency", "_flag", "_at", "TaxRate", "")))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.get(ends, (F.col("p_partkey") % 9).cast("int"))).alias("name"))


DISPLAY = "CASE WHEN k LIKE '%\\_id' ESCAPE '\\' OR k = 'id' THEN 'id' WHEN regexp_matches(k, 'amount|total|rate|price|qty|count') THEN 'numeric' WHEN contains(k, 'date') OR k LIKE '%\\_at' ESCAPE '\\' OR contains(k, 'time') THEN 'timestamp' WHEN contains(k, 'status') OR contains(k, 'state') THEN 'status/text' WHEN contains(k, 'currency') THEN 'currency/text' WHEN contains(k, 'flag') OR starts_with(k, 'is_') OR starts_with(k, 'has_') THEN 'boolean-like' ELSE 'text' END"


@query(f"WITH {NAMES}, l AS (SELECT *, lower(name) AS k FROM n) SELECT p_partkey, name, {DISPLAY} AS display, CASE WHEN contains(k, 'date') OR contains(k, 'time') THEN 'datetime2' WHEN k LIKE '%\\_id' ESCAPE '\\' OR k = 'id' THEN 'int' WHEN regexp_matches(k, 'amount|total|price|tax|rate') THEN 'money' ELSE 'nvarchar' END AS sql_type FROM l")
def inferred_types(spark, sf_dir):
    return part_names(spark, sf_dir).select("p_partkey", "name", R.display_type(F.col("name")).alias("display"), R.sql_type(F.col("name")).alias("sql_type"))


SCHEMAS = ("finance", "PROD_sales", "legacy_core", "wms", "temp_x", "app", "clinical", "sales", "hr")
TABLES = ("customer_invoice", "product_list", "tmp_a", "promo_codes", "accounts", "12345", "monthly_forecast", "orders")
KEYED = f"t AS (SELECT o_orderkey, {list(SCHEMAS)}[1 + o_orderkey % 9] AS s, {list(TABLES)}[1 + o_custkey % 8] AS t, CASE WHEN o_orderkey % 50 = 3 THEN 'Legacy-Hebrew import' ELSE o_orderpriority END AS c FROM orders)"
DOMAIN = (
    "CASE WHEN contains(lower(s), 'temp') OR contains(t, 'tmp') THEN 'Technical Debt' WHEN contains(lower(c), 'legacy-hebrew') OR t = '12345' THEN 'Legacy Core'"
    " WHEN s = 'finance' THEN 'Finance' WHEN s = 'wms' THEN 'Logistics' WHEN s = 'clinical' THEN 'CRM' WHEN s = 'hr' THEN 'Operations' WHEN s = 'legacy_core' THEN 'Legacy Core'"
    " WHEN s IN ('PROD_sales', 'sales') THEN CASE t WHEN 'customer_invoice' THEN 'Finance' WHEN 'accounts' THEN 'CRM' WHEN 'product_list' THEN 'Logistics' ELSE 'Operations' END"
    " ELSE CASE t WHEN 'customer_invoice' THEN 'Finance' WHEN 'product_list' THEN 'Logistics' WHEN 'accounts' THEN 'CRM' WHEN 'promo_codes' THEN 'Marketing' WHEN 'monthly_forecast' THEN 'Analytics' ELSE 'Operations' END END"
)
EFFORT = "CASE WHEN d = 'Technical Debt' THEN 52 WHEN s = 'legacy_core' OR t = '12345' THEN 40 WHEN s IN ('PROD_sales', 'sales') THEN 18 ELSE 26 END"


def keyed_orders(spark, sf_dir) -> DataFrame:
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col(n) % len(values)).cast("int"))
    comment = F.when(F.col("o_orderkey") % 50 == 3, "Legacy-Hebrew import").otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", of(SCHEMAS, "o_orderkey").alias("s"), of(TABLES, "o_custkey").alias("t"), comment.alias("c"))


@query(f"WITH {KEYED}, d AS (SELECT *, {DOMAIN} AS d FROM t) SELECT o_orderkey, d AS domain, {EFFORT} AS effort FROM d")
def business_domains(spark, sf_dir):
    rows = keyed_orders(spark, sf_dir).withColumn("domain", R.business_domain(F.col("s"), F.col("t"), F.col("c")))
    return rows.select("o_orderkey", "domain", R.migration_effort(F.col("s"), F.col("t"), F.col("domain")).alias("effort"))


@query(
    "SELECT p_partkey, concat(CASE WHEN p_size = 7 THEN 'Lucky.' ELSE concat('Attribute ', name, ' of the ', CASE WHEN p_size % 3 = 0 THEN 'operational' ELSE p_brand END, ' domain.') END, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(' (context: ', p_brand, ')') END) AS definition, "
    "concat(p_name, ' belongs to ', p_brand, ' and is read by about ', p_size, ' queries. ', CASE WHEN p_size % 2 = 0 THEN concat('Noted: ', p_type, '.') ELSE concat('Test its consumers with the ', p_brand, ' wave.') END) AS blurb FROM (SELECT *, concat('c', p_size) AS name FROM part) p"
)
def column_definitions(spark, sf_dir):
    domain = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand"))
    said = R.definition(F.concat(F.lit("c"), "p_size"), domain, {"C7": "Lucky."})
    about = R.blurb(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", said.alias("definition"), about.alias("blurb"))


FLAGGED = """i AS (SELECT DISTINCT p_partkey // 10 AS item, concat('d', p_partkey // 10 % 5) AS domain FROM part),
c AS (SELECT p_partkey // 10 AS item, col, min(kind) AS type FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN concat('Col', p_size) ELSE concat('c_', p_size) END AS col, CASE WHEN p_partkey % 50 = 0 THEN 'VarBinary' WHEN p_retailprice > 1500 THEN 'INT' ELSE 'NVARCHAR' END AS kind FROM part WHERE p_partkey // 10 % 9 <> 5 OR p_partkey % 10 < 2) p GROUP BY 1, 2),
m AS (SELECT c.item, i.domain, col, lower(type) AS type FROM c JOIN i ON i.item = c.item),
o AS (SELECT a.item, a.col, a.type, min((b.item, b.type)) AS other FROM m AS a JOIN (SELECT domain, col, type, min(item) AS item FROM m GROUP BY 1, 2, 3) AS b ON a.domain = b.domain AND a.col = b.col AND a.type <> b.type GROUP BY 1, 2, 3),
w AS (SELECT i.item, i.domain, count(col) AS n, count(col) FILTER (WHERE contains(col, '_')) AS snakes, count(col) FILTER (WHERE NOT contains(col, '_')) AS humps FROM i LEFT JOIN c ON c.item = i.item GROUP BY 1, 2),
s AS (SELECT domain, avg(n) AS mean, stddev_pop(n) AS dev FROM w GROUP BY 1),
x AS (SELECT p_partkey // 10 AS item, count(*) AS cells, count(*) FILTER (WHERE p_size < 25) AS nulls FROM part WHERE p_partkey // 10 % 3 > 0 GROUP BY 1),
f AS (SELECT item, 'BLOCK' AS level, 'unsupported_blob_type' AS name, concat('Column ', col, ' has type ', upper(type)) AS reason FROM m WHERE type = 'varbinary'
UNION ALL SELECT item, 'BLOCK', 'cluster_type_inconsistency', concat('Column ', col, ': ', upper(type), ' here, ', upper(other[2]), ' in ', other[1]) FROM o
UNION ALL SELECT item, 'WARN', 'column_count_outlier', concat(n, ' columns, the domain''s mean is ', CAST(round(mean) AS BIGINT)) FROM w JOIN s ON s.domain = w.domain WHERE dev > 0 AND n > mean + 2 * dev
UNION ALL SELECT item, 'WARN', 'high_null_rate', concat(nulls, ' of ', cells, ' sampled values are null') FROM x WHERE nulls / cells > 0.5
UNION ALL SELECT item, 'INFO', 'null_rate_check_skipped', 'no sampled rows' FROM i WHERE item % 3 = 0
UNION ALL SELECT item, 'INFO', 'naming_entropy', concat(snakes, ' names with _, ', humps, ' with capitals') FROM w WHERE snakes > 0 AND humps > 0
UNION ALL SELECT p_partkey // 10, 'WARN', 'hitl_rejected_mapping', concat('Rejected mapping of ', p_name, ' to ', p_type) FROM part WHERE p_partkey % 400 = 7
UNION ALL SELECT item, 'BLOCK', 'outside_manifest_scope', 'not in the manifest' FROM i WHERE item % 20 = 0)"""


def part_flags(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("item", F.expr("p_partkey div 10"))
    items = p.select("item", F.concat(F.lit("d"), (F.col("item") % 5).cast("string")).alias("domain")).distinct()
    col = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Col"), "p_size")).otherwise(F.concat(F.lit("c_"), "p_size"))
    kind = F.when(F.col("p_partkey") % 50 == 0, "VarBinary").when(F.col("p_retailprice") > 1500, "INT").otherwise("NVARCHAR")
    columns = p.where("item % 9 <> 5 or p_partkey % 10 < 2").groupBy("item", col.alias("col")).agg(F.min(kind).alias("type"))
    samples = p.where("item % 3 > 0").groupBy("item").agg(F.count("*").alias("cells"), F.count_if(F.col("p_size") < 25).alias("nulls"))
    rejected = p.where("p_partkey % 400 = 7").select("item", F.col("p_name").alias("legacy"), F.col("p_type").alias("target"))
    return R.anomaly_flags(items, columns, samples, rejected, items.where("item % 20 <> 0").select("item"))


@query(f"WITH {FLAGGED} SELECT * FROM f")
def anomaly_flags(spark, sf_dir):
    return part_flags(spark, sf_dir)


def order_audit(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("item")).distinct()
    decision = F.when(F.col("item") % 4 == 0, "reject").otherwise("approve")
    scored = p.select("item", decision.alias("decision"), (F.col("item") % 101).alias("confidence"), F.lit("by score").alias("reason"), F.concat(F.lit("c-"), "item").alias("contract"), F.lit("reviewer").alias("approver"))
    return U.audit_rows(scored, part_flags(spark, sf_dir))


@query(
    f"WITH {FLAGGED}, u AS (SELECT DISTINCT * FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE level WHEN 'BLOCK' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, name, reason) AS rn FROM u), k AS (SELECT item, count(*) AS n, min(reason) FILTER (WHERE rn = 1) AS reason FROM r GROUP BY 1) SELECT i.item, CASE WHEN i.item % 4 = 0 THEN 'reject' ELSE 'approve' END AS decision, i.item % 101 AS confidence, coalesce(n, 0) AS flags, coalesce(k.reason, 'by score') AS primary_reason FROM i LEFT JOIN k ON k.item = i.item"
)
def audit_trail(spark, sf_dir):
    """Audit entries appended in two parts and read back."""
    path, rows = folder(spark, "audit"), order_audit(spark, sf_dir)
    for half in ("reject", "approve"):
        U.append_audit(rows.where(F.col("decision") == half), path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("item", "decision", "confidence", F.size("flags").cast("long").alias("flags"), "primary_reason")


@query(f"WITH {CATALOG}, {USAGE}, c AS (SELECT table_key, lower(col) AS k, min(col) AS c FROM cat GROUP BY 1, 2), n AS (SELECT table_key, lower(name) AS k, min(name) AS n FROM u GROUP BY 1, 2), b AS (SELECT coalesce(c.table_key, n.table_key) AS table_key, coalesce(c, n) AS col, coalesce(c.k, n.k) AS k, c IS NOT NULL AS in_catalog, n IS NOT NULL AS in_use FROM c FULL JOIN n ON n.table_key = c.table_key AND n.k = c.k) SELECT table_key, col, in_catalog, in_use, {DISPLAY} AS kind, CAST(NULL AS VARCHAR) AS latin FROM b")
def table_profiles(spark, sf_dir):
    return R.table_profile(part_catalog(spark, sf_dir), part_usage(spark, sf_dir).select("table_key", F.col("name").alias("col")))


@query("SELECT c_custkey, concat('C***@***.example') AS contact, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10")
def sample_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C"), "c_custkey", F.lit("@mail.example")).alias("contact"), "c_mktsegment")
    return R.masked_sample(rows, "c_custkey", 50)


@query("SELECT event_id, concat('cluster_', min(event_id) OVER (PARTITION BY lower(concat(event_type, ' ', user_id)))) AS cluster, CASE WHEN min(event_id) OVER (PARTITION BY lower(concat(event_type, ' ', user_id))) = 3 THEN 'Core' ELSE 'Rest' END AS rollup FROM events")
def identity_clusters(spark, sf_dir):
    identity = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), "user_id")
    return R.identity_clusters(read(spark, sf_dir, "events"), identity, "event_id", {"cluster_3": "Core", "default": "Rest"})


@query("SELECT concat('o', doc_id) AS signature, CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS action FROM labels WHERE doc_id % 10 <> 4")
def stored_decisions(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    body = F.concat(F.lit('{"version": 1, "decisions": {"o'), "doc_id", F.lit('": {"action": "'), F.when(F.col("quality") == 1, "approve").otherwise("reject"), F.lit('", "row": {"a": 1}}}}'))
    return U.review_decisions(rows.select(F.when(F.col("doc_id") % 10 == 4, "{not json").otherwise(body).alias("value")))


@query("SELECT concat('m', l_orderkey, '_', l_linenumber) AS model, concat(CASE WHEN l_returnflag = 'N' THEN '' ELSE concat(l_returnflag, '.') END, CASE WHEN l_linenumber % 2 = 0 THEN 'al' ELSE concat('m', l_orderkey, '_', l_linenumber) END) AS relation, CASE WHEN l_linestatus = 'O' THEN 'view' ELSE 'table' END AS materialized, 2 AS columns, CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_linenumber % 2 = 0 THEN 'k' ELSE 'k,l' END AS unique_key FROM lineitem WHERE l_linenumber <> 3")
def manifest_models(spark, sf_dir):
    """Manifests with a node for each line of an order; every third line is a test, not a model."""
    flag = F.when(F.col("l_returnflag") == "N", '""').otherwise(F.concat(F.lit('"'), "l_returnflag", F.lit('"')))
    config = F.when(F.col("l_linestatus") == "O", "{}").when(F.col("l_linenumber") % 2 == 0, '{"materialized": "table", "unique_key": "k"}').otherwise('{"materialized": "table", "unique_key": ["k", "l"]}')
    alias = F.when(F.col("l_linenumber") % 2 == 0, ', "alias": "al"').otherwise("")
    name = F.concat(F.lit("m"), "l_orderkey", F.lit("_"), "l_linenumber")
    node = F.concat(F.lit('"'), name, F.lit('": {"resource_type": "'), F.when(F.col("l_linenumber") == 3, "test").otherwise("Model"), F.lit('", "name": "'), name, F.lit('", "schema": '), flag, alias, F.lit(', "columns": {"a": {"type": "x"}, "b": {}}, "config": '), config, F.lit("}"))
    texts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('{"nodes": {'), F.array_join(F.collect_list(node), ", "), F.lit("}}")).alias("value"))
    return U.model_nodes(texts).select("model", "relation", "materialized", F.size("columns").alias("columns"), F.array_join("unique_key", ",").alias("unique_key"))


BUSY = "b AS (SELECT DISTINCT l_orderkey AS stmt, l_suppkey AS item FROM lineitem WHERE l_suppkey IS NOT NULL)"


@query(f"WITH {BUSY}, c AS (SELECT item, count(*) AS query_count FROM b GROUP BY 1), e AS (SELECT x.item AS a, y.item AS b FROM b AS x JOIN b AS y ON x.stmt = y.stmt AND x.item < y.item GROUP BY 1, 2) SELECT c.item, query_count, count(a) AS later FROM c LEFT JOIN e ON e.a = c.item GROUP BY 1, 2")
def bundle_round_trip(spark, sf_dir):
    """Inventory and edges written as a bundle, read back and joined."""
    path = folder(spark, "bundle")
    U.write_bundle({"inventory": supplier_inventory(spark, sf_dir), "edges": supplier_edges(spark, sf_dir)}, path)
    b = U.read_bundle(spark, path, ["inventory", "edges"])
    later = b["edges"].groupBy(F.col("a").alias("item")).agg(F.count("*").alias("later"))
    return b["inventory"].join(later, "item", "left").select("item", "query_count", F.coalesce("later", F.lit(0)).alias("later"))


@query("SELECT DISTINCT concat('s', s_nationkey) AS schema, s_name AS \"table\", concat('c', l_linenumber) AS col, 'int' AS type FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def extraction_round_trip(spark, sf_dir):
    """Column lists and statements written as JSON, the lists read back."""
    path = folder(spark, "extraction")
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    catalog = rows.select(F.concat(F.lit("s"), "s_nationkey").alias("schema"), F.col("s_name").alias("table"), F.concat(F.lit("c"), "l_linenumber").alias("col"), F.lit("int").alias("type")).distinct()
    statements = read(spark, sf_dir, "events").select(F.lit("prod").alias("env"), F.lit("tsql").alias("dialect"), F.col("event_type").alias("sql"))
    U.write_extraction(catalog, statements, path)
    return U.read_catalog(spark, path)
