"""Queries of filters, selections and unions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping_queries import CATALOG, MAPPING, USAGE, WAVES, part_catalog, part_mapping, part_usage, planned_parts
from .operators import selection as L
from .register import query, read
from .registry import EDGES, supplier_edges

SCORED = "sc AS (SELECT c_custkey AS item, c_mktsegment AS domain, CASE WHEN c_custkey % 5 = 0 THEN 'red' WHEN c_custkey % 5 < 3 THEN 'yellow' ELSE 'green' END AS queue, c_custkey % 101 AS confidence, c_nationkey * 4 AS criticality FROM customer)"


def scored_customers(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    queue = F.when(n % 5 == 0, "red").when(n % 5 < 3, "yellow").otherwise("green")
    return read(spark, sf_dir, "customer").select(n.alias("item"), F.col("c_mktsegment").alias("domain"), queue.alias("queue"), (n % 101).alias("confidence"), (F.col("c_nationkey") * 4).alias("criticality"))


@query(f"WITH {SCORED} SELECT * FROM sc WHERE queue IN ('green', 'yellow') AND domain = 'MACHINERY' AND confidence BETWEEN 40 AND 90 AND criticality BETWEEN 0 AND 60")
def scored_inventory(spark, sf_dir):
    return L.scored_rows(scored_customers(spark, sf_dir), ["green", "yellow"], "MACHINERY", (40, 90), (0, 60), sort="confidence", descending=True)


@query(f"WITH {SCORED}, o AS (SELECT DISTINCT o_custkey + 7 AS item FROM orders WHERE o_orderstatus = 'P') SELECT o.item, coalesce(queue, 'unknown') = 'green' AS proceed, CASE WHEN coalesce(queue, 'unknown') <> 'green' THEN concat('queue is ', coalesce(queue, 'unknown')) END AS reason FROM o LEFT JOIN sc ON sc.item = o.item")
def bulk_split(spark, sf_dir):
    chosen = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") + 7).alias("item"))
    return L.bulk_split(chosen, scored_customers(spark, sf_dir))


@query("SELECT item FROM (SELECT o_custkey AS item FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal >= 7000 UNION SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 20) q")
def high_risk_set(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    many = o.groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("score"))
    return L.high_risk(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("item")), c.select(F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("priority")), many, priority=7000, score=20)


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type WHEN trim(props) <> '' THEN props END AS sql, lower(event_type) = 'click' AS in_scope FROM events")
def statement_text(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("sql", F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(" "))
    return e.select("event_id", L.first_text("sql", "props").alias("sql"), L.in_scope(F.col("event_type"), "app.click").alias("in_scope"))


@query(f"WITH {CATALOG}, {USAGE}, c AS (SELECT table_key, lower(col) AS k, min(col) AS c FROM cat GROUP BY 1, 2), n AS (SELECT table_key, lower(name) AS k, min(name) AS n FROM u GROUP BY 1, 2) SELECT coalesce(c.table_key, n.table_key) AS table_key, coalesce(c, n) AS col, c IS NOT NULL AS in_catalog, n IS NOT NULL AS in_use FROM c FULL JOIN n ON n.table_key = c.table_key AND n.k = c.k")
def columns_by_usage(spark, sf_dir):
    return L.columns_by_usage(part_catalog(spark, sf_dir), part_usage(spark, sf_dir).select("table_key", F.col("name").alias("col")))


@query("WITH g AS (SELECT 0 AS layer, p_name AS term, p_type AS target FROM part WHERE p_size > 25 UNION ALL SELECT 1, upper(p_name), p_brand FROM part UNION ALL SELECT 1, '_note', p_brand FROM part), r AS (SELECT lower(replace(trim(term), ' ', '_')) AS term, target, layer FROM g WHERE term NOT LIKE '\\_%' ESCAPE '\\') SELECT term, target, layer FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY layer, target) AS rn FROM r) q WHERE rn = 1")
def layered_glossary(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    clean = p.where("p_size > 25").select(F.lit(0).alias("layer"), F.col("p_name").alias("term"), F.col("p_type").alias("target"))
    dirty = p.select(F.lit(1), F.upper("p_name"), "p_brand").union(p.select(F.lit(1), F.lit("_note"), "p_brand"))
    return L.layered_glossary(clean.union(dirty))


@query("WITH a AS (SELECT user_id, 0 AS part, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, 1, min(event_id) FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, part, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part) AS rn FROM a) q WHERE rn = 1")
def ordered_union(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return L.ordered_union(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), key="user_id", order="event_id")


@query(
    """WITH n AS (SELECT doc_id AS key, sha256(coalesce(text, '')) AS digest FROM documents WHERE lang <> 'de'), o AS (SELECT doc_id AS key, sha256(CASE WHEN n_chars > 500 THEN text ELSE lower(text) END) AS old FROM documents WHERE source <> 'web')
SELECT coalesce(n.key, o.key) AS key, coalesce(digest, old) AS digest, CASE WHEN digest IS NULL THEN 'removed' WHEN old IS NULL THEN 'added' WHEN digest = old THEN 'same' ELSE 'changed' END AS change FROM n FULL JOIN o ON o.key = n.key"""
)
def changed_entries(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old = d.where("source <> 'web'").select(F.col("doc_id").alias("key"), F.sha2(F.when(F.col("n_chars") > 500, F.col("text")).otherwise(F.lower("text")), 256).alias("digest"))
    return L.changed(d.where("lang <> 'de'").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), old)


@query(f"WITH {MAPPING} SELECT table_key AS item, CAST(least(round_even(70.0 * count(*) FILTER (WHERE confidence >= 0.85) / count(*), 0) + round_even(30.0 * count(*) FILTER (WHERE n_join > 0) / count(*), 0), 100) AS INTEGER) AS confidence FROM m GROUP BY 1")
def confidence_scores(spark, sf_dir):
    return L.confidence_scores(part_mapping(spark, sf_dir).select(F.col("table_key").alias("item"), (F.col("confidence") >= 0.85).alias("matched"), (F.col("n_join") > 0).alias("typed")))


@query(f"WITH {WAVES} SELECT 'Epic' AS kind, concat('Wave ', wave) AS summary, '' AS parent, concat(count(*), ' table(s)') AS description FROM pl GROUP BY wave UNION ALL SELECT 'Story', concat('Migrate ', item), concat('Wave ', wave), p_name FROM pl JOIN part ON p_partkey = item")
def ticket_tree(spark, sf_dir):
    return L.tickets(planned_parts(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text")))


@query("SELECT sql, ran_at FROM (SELECT concat('SELECT ', event_type, ' FROM u', user_id) AS sql, max(ts) AS ran_at FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts < TIMESTAMP '2024-01-16' GROUP BY 1) q ORDER BY ran_at DESC, sql LIMIT 500")
def query_history(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").alias("ran_at"), F.concat(F.lit("SELECT "), "event_type", F.lit(" FROM u"), "user_id").alias("sql"))
    return L.history(rows, "1970-01-01", "2024-01-15", 500)


@query("SELECT script, pos, sql FROM (SELECT o_orderkey AS script, unnest([0, 2]) AS pos, unnest([concat('SELECT ', o_custkey), concat('DELETE FROM t WHERE s = ', o_orderstatus)]) AS sql FROM orders) q")
def script_batches(spark, sf_dir):
    text = F.concat(F.lit("SELECT "), "o_custkey", F.lit("\n go \nSET NOCOUNT ON\r\nGO\r\n DELETE FROM t WHERE s = "), "o_orderstatus", F.lit("\nGO\n"))
    return L.batches(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("script"), text.alias("text")))


@query("SELECT o_orderkey AS stmt, o_orderstatus <> 'P' AS is_select, o_custkey % 2 = 0 AS has_filter, o_orderstatus = 'F' AS placeholder, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS casts FROM orders")
def query_lint(spark, sf_dir):
    head = F.when(F.col("o_orderstatus") == "P", "UPDATE t SET a = 1").when(F.col("o_orderstatus") == "F", "SELECT * FROM t").otherwise("select a from t")
    tail = F.when(F.col("o_custkey") % 2 == 0, " WHERE CAST(a AS NTEXT) = 'x'").otherwise("")
    return L.lint(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stmt"), F.concat(head, tail).alias("sql")))


def occurrences(word: str) -> str:
    return f"(length(low) - length(replace(low, '{word}', ''))) // {len(word)}"


@query(f"SELECT doc_id, CAST(4 * ({occurrences('of.the')}) + 2 * ({occurrences('the')}) + 1.5 * len(regexp_extract_all(low, '\\b(?:from|join)\\s+(?:[a-z_][a-z0-9_]*\\.)*the\\b')) AS DOUBLE) AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) d")
def file_scores(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", L.file_score(F.col("text"), "of", "the").alias("score"))


@query(f"WITH {EDGES}, k AS (SELECT 7 AS child, s_suppkey AS parent FROM supplier WHERE s_nationkey < 12 AND s_suppkey <> 7), un AS (SELECT CASE WHEN a = 7 THEN b ELSE a END AS other, weight FROM e WHERE a = 7 OR b = 7) SELECT coalesce(un.other, k.parent) AS other, CASE WHEN k.parent IS NULL THEN 'coquery' WHEN un.other IS NULL THEN 'key' ELSE 'both' END AS kind, coalesce(weight, 0) AS shared FROM un FULL JOIN k ON k.parent = un.other")
def key_usage_neighbourhood(spark, sf_dir):
    keys = read(spark, sf_dir, "supplier").where("s_nationkey < 12 and s_suppkey <> 7").select(F.lit(7).cast("long").alias("child"), F.col("s_suppkey").alias("parent"))
    return L.two_layer_neighbourhood(keys, supplier_edges(spark, sf_dir), 7)


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings, q) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 8")
def nearest_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return L.nearest(rows, rows.where("vec_id = 0").first()["embedding"], 8)
