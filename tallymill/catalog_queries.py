"""Queries of catalog readers, statement filters and table checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import quality as Q
from .register import query, read
from .sources import catalogs as K


@query("SELECT s_suppkey AS table_key, pos, CASE pos WHEN 0 THEN s_name ELSE concat('n', s_nationkey) END AS col, CASE WHEN pos = 1 AND s_suppkey % 2 = 0 THEN 'int' ELSE '' END AS type FROM supplier, (VALUES (0), (1)) v(pos) WHERE s_suppkey % 10 <> 3")
def column_catalogs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    plain = F.concat(F.lit('["'), "s_name", F.lit('", "n'), "s_nationkey", F.lit('"]'))
    typed = F.concat(F.lit('{"columns": ["'), "s_name", F.lit('", {"name": "n'), "s_nationkey", F.lit('", "type": "int"}]}'))
    value = F.when(F.col("s_suppkey") % 10 == 3, '["broken').when(F.col("s_suppkey") % 2 == 0, typed).otherwise(plain)
    return K.column_catalog(s.select(F.col("s_suppkey").alias("table_key"), value.alias("value")))


@query("SELECT concat('app.t', o_orderkey) AS table_key, CASE WHEN o_orderkey % 4 = 0 THEN concat('ddl/', o_custkey) ELSE concat('d/', o_custkey, '.json') END AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'oracle' END AS source_dialect, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS owner, CAST(NULL AS VARCHAR) AS tablespace FROM orders")
def manifest_entries(spark, sf_dir):
    entry = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"ddl_path": "ddl/'), "o_custkey", F.lit('", "source_dialect": "oracle", "owner": "'), "o_orderstatus", F.lit('"}'))).otherwise(F.concat(F.lit('"d/'), "o_custkey", F.lit('.json"')))
    value = F.concat(F.lit('{"_comment": "x", "APP.T'), "o_orderkey", F.lit('": '), entry, F.lit("}"))
    return K.manifest_entries(read(spark, sf_dir, "orders").select(value.alias("value")))


@query("SELECT o_orderkey AS script, CASE k WHEN 0 THEN concat('sales.t', o_custkey) ELSE 'plain' END AS table_key, CASE k WHEN 0 THEN 'sales' END AS owner, CASE k WHEN 0 THEN concat('ts_', lower(o_orderstatus)) END AS tablespace FROM orders, (VALUES (0), (1)) v(k)")
def created_tables(spark, sf_dir):
    sql = F.concat(F.lit("CREATE TABLE Sales.T"), "o_custkey", F.lit(" (a INT,\n b VARCHAR(10)) TABLESPACE TS_"), "o_orderstatus", F.lit(";\ncreate  table plain(x int);"))
    return K.created_tables(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("script"), sql.alias("sql")))


@query("SELECT concat(source, CASE WHEN lang = 'de' THEN '_Dirty.json' ELSE '.json' END) AS file, CASE WHEN lang = 'de' THEN 'dirty' ELSE 'clean' END AS layer, count(*) AS entries FROM documents WHERE doc_id % 3 > 0 GROUP BY source, lang = 'de', layer")
def glossary_inventory(spark, sf_dir):
    file = F.concat("source", F.when(F.col("lang") == "de", "_Dirty.json").otherwise(".json"))
    term = F.when(F.col("doc_id") % 3 == 0, "_note").otherwise(F.col("doc_id").cast("string"))
    return K.glossary_inventory(read(spark, sf_dir, "documents").select(file.alias("file"), term.alias("term"), F.lit("t").alias("target")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('full ', p_partkey) WHEN p_size % 3 = 1 THEN 'by schema' WHEN p_brand = 'Brand#11' THEN 'by table' END AS comment FROM part")
def table_comments(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("schema", F.when(F.col("p_size") % 3 == 1, "s1").otherwise("S0"))
    items = p.select("p_partkey", F.concat(F.lit("D"), "p_partkey", F.lit("_"), F.col("p_size") % 3).alias("db"), "schema", F.col("p_brand").alias("table"))
    full = items.where("db like '%\\\\_0'").select(F.lower(F.concat_ws(".", "db", "schema", "table")).alias("key"), F.concat(F.lit("full "), "p_partkey").alias("comment"))
    short = p.select(F.concat(F.lit("S1."), "p_brand").alias("key"), F.lit("by schema").alias("comment")).distinct()
    bare = p.where("p_brand = 'Brand#11'").select(F.lit("BRAND#11").alias("key"), F.lit("by table").alias("comment")).distinct()
    return K.side_metadata(items, full.union(short).union(bare)).select("p_partkey", "comment")


STATEMENTS = ("SELECT a FROM sales.t", "EXEC sp_help", "SET NOCOUNT ON", "SELECT * FROM sys.tables", "select b from [Sales].u", " ", "SELECT c FROM presales.x", "DROP DATABASE d", "UPDATE t SET a = 1")


@query("SELECT event_id, event_id % 9 IN (1, 2, 3, 5, 7) AS noise, event_id % 9 IN (0, 4) AS sales, event_id % 2 = 0 AS qualified FROM events")
def statement_noise(spark, sf_dir):
    sql = F.get(F.array(*map(F.lit, STATEMENTS)), (F.col("event_id") % 9).cast("int"))
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("app."), "event_type")).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", K.is_noise(sql).alias("noise"), K.mentions_schema(sql, ["sales"]).alias("sales"), K.qualified(key).alias("qualified"))


@query("SELECT p_partkey AS item, p_name, p_type FROM part WHERE (contains(lower(p_name), 're') OR contains(lower(p_type), 're')) AND p_size <= 40")
def row_search(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    done = p.where("p_size > 40").select(F.col("p_partkey").alias("item"))
    return K.search(p.select(F.col("p_partkey").alias("item"), "p_name", "p_type"), "RE", ["p_name", "p_type"], done)


def order_checks(spark, sf_dir) -> DataFrame:
    o, li, e = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    lost = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    n = F.count_if(F.col("l_discount") > 0.08)
    return Q.suite(
        [
            Q.not_empty(o, "orders_present"),
            Q.not_empty(o.where("o_totalprice < 0"), "negative_totals_present"),
            Q.check(lost, "lines_have_orders", F.count("*") > 0, detail=F.count("*")),
            Q.check(li, "few_high_discounts", n > F.count("*"), n > 0, n),
            Q.version_is(e.select(F.when(F.col("event_id") % 100 > 0, "2").alias("v")), "version", "v", "2"),
        ]
    )


CHECKS = """c AS (SELECT 'orders_present' AS "check", CASE WHEN count(*) = 0 THEN 'error' ELSE 'ok' END AS status, CAST(count(*) AS VARCHAR) AS detail FROM orders
UNION ALL SELECT 'negative_totals_present', CASE WHEN count(*) = 0 THEN 'error' ELSE 'ok' END, CAST(count(*) AS VARCHAR) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'lines_have_orders', CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'few_high_discounts', CASE WHEN count(*) FILTER (WHERE l_discount > 0.08) > 0 THEN 'warn' ELSE 'ok' END, CAST(count(*) FILTER (WHERE l_discount > 0.08) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'version', CASE WHEN count(*) = 0 THEN 'error' WHEN count(*) FILTER (WHERE event_id % 100 = 0) > 0 THEN 'warn' ELSE 'ok' END, '0' FROM events)"""


@query(f"WITH {CHECKS} SELECT * FROM c")
def check_suite(spark, sf_dir):
    return order_checks(spark, sf_dir)


@query(f"WITH {CHECKS} SELECT count(*) FILTER (WHERE status = 'error') = 0 AS ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'warn') AS warnings, count(*) FILTER (WHERE status = 'ok') AS passed FROM c")
def check_verdict(spark, sf_dir):
    return Q.verdict(order_checks(spark, sf_dir))


@query("SELECT 'k' AS field, count(*) FILTER (WHERE event_id % 50 = 0) AS missing, count(*) FILTER (WHERE event_id % 50 = 1) AS invalid FROM events UNION ALL SELECT 'at', 0, count(*) FILTER (WHERE event_id % 20 = 0) FROM events")
def field_validation(spark, sf_dir):
    k = F.when(F.col("event_id") % 50 == 1, "many").when(F.col("event_id") % 50 > 1, F.get_json_object("props", "$.k"))
    at = F.when(F.col("event_id") % 20 == 0, "yesterday").otherwise(F.col("ts").cast("string"))
    return Q.invalid_fields(read(spark, sf_dir, "events").select(k.alias("k"), at.alias("at")), {"k": "bigint", "at": "timestamp"})


@query("WITH e AS (SELECT DISTINCT p_brand AS table_key, lower(p_name) AS col FROM part WHERE p_size < 30), a AS (SELECT DISTINCT p_brand AS table_key, lower(p_name) AS col FROM part WHERE p_size > 20) SELECT table_key, col, 'missing' AS state FROM (FROM e EXCEPT FROM a) UNION ALL SELECT table_key, col, 'unexpected' FROM (FROM a EXCEPT FROM e)")
def spec_conformance(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("table_key"), F.col("p_name").alias("col"), "p_size")
    return Q.conformance(p.where("p_size < 30"), p.where("p_size > 20").withColumn("col", F.upper("col")))
