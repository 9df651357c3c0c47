"""Queries of inventories, scored filters, labels and readers' odd records, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as T
from .operators import baskets as B
from .operators import extract as X
from .mapping_queries import MAPPING, part_mapping
from .operators import graph as G
from .operators import mapping as M
from .operators import reports as R
from .operators import scoring as S
from .operators import selection as L
from .plans.scratch import scratch_dir
from .register import query, read
from .sources import catalogs, logs

SCORED = """sc AS (SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN 'CRM.' WHEN c_custkey % 3 = 1 THEN 'hr.' ELSE '' END, 'c', c_custkey) AS item, c_mktsegment AS domain,
  CASE WHEN c_custkey % 5 = 0 THEN 'red' WHEN c_custkey % 5 < 3 THEN 'yellow' ELSE 'green' END AS queue, CASE WHEN c_acctbal < 0 THEN 'Empty' ELSE 'Ready' END AS status, c_custkey % 101 AS confidence, c_nationkey * 4 AS criticality, c_custkey AS k FROM customer),
fl AS (SELECT item, 'BLOCK' AS level, 'unsupported_blob_type' AS name FROM sc WHERE k % 7 = 0 UNION ALL SELECT item, 'WARN', 'high_null_rate' FROM sc WHERE k % 2 = 0 UNION ALL SELECT item, 'WARN', 'high_null_rate' FROM sc WHERE k % 4 = 0)"""


def scored_tables(spark, sf_dir):
    """Scored rows of dotted and plain names, and their flags, some of them twice."""
    k = F.col("c_custkey")
    item = F.concat(F.when(k % 3 == 0, "CRM.").when(k % 3 == 1, "hr.").otherwise(""), F.lit("c"), k)
    queue = F.when(k % 5 == 0, "red").when(k % 5 < 3, "yellow").otherwise("green")
    rows = read(spark, sf_dir, "customer").select(item.alias("item"), F.col("c_mktsegment").alias("domain"), queue.alias("queue"), F.when(F.col("c_acctbal") < 0, "Empty").otherwise("Ready").alias("status"), (k % 101).alias("confidence"), (F.col("c_nationkey") * 4).alias("criticality"), k.alias("k"))
    flag = lambda test, level, name: rows.where(test).select("item", F.lit(level).alias("level"), F.lit(name).alias("name"))
    flags = flag("k % 7 = 0", "BLOCK", "unsupported_blob_type").union(flag("k % 2 = 0", "WARN", "high_null_rate")).union(flag("k % 4 = 0", "WARN", "high_null_rate"))
    return rows.drop("k"), flags


@query(f"""WITH {SCORED}, g AS (SELECT item, list_sort(list_distinct(list(concat(level, ':', name)))) AS flags FROM fl GROUP BY item)
SELECT sc.item, domain, queue, status, confidence, criticality, flags FROM sc JOIN g ON g.item = sc.item
WHERE k % 3 = 0 AND status = 'Ready' AND sc.item IN (SELECT item FROM fl WHERE level = 'WARN') AND sc.item IN (SELECT item FROM fl WHERE level = 'BLOCK') AND confidence >= 10 AND criticality <= 90""")
def scored_query(spark, sf_dir):
    """Scored rows by schema, status, level and blob flag."""
    rows, flags = scored_tables(spark, sf_dir)
    return L.scored_query(rows, flags, schema="crm", status="Ready", anomaly_level="warn", has_blob=True, confidence=(10, 100), criticality=(0, 90))


@query(f"""WITH {SCORED} SELECT 'green' AS asked, count(*) FILTER (WHERE queue = 'green') AS proceed, count(*) FILTER (WHERE queue <> 'green') AS skipped FROM sc
UNION ALL SELECT 'red', 0, 1 UNION ALL SELECT 'dry', 0, 0""")
def bulk_kinds(spark, sf_dir):
    """A bulk of green items, one of red items that is refused, and a dry run."""
    rows, _ = scored_tables(spark, sf_dir)
    count = lambda name, df: df.agg(F.lit(name).alias("asked"), F.count_if("proceed").alias("proceed"), F.count_if(~F.col("proceed")).alias("skipped"))
    return count("green", L.bulk_split(rows, rows)).union(count("red", L.bulk_split(rows, rows, "RED"))).union(count("dry", L.bulk_split(rows, rows, dry_run=True)))


@query("""WITH c AS (SELECT concat(CASE WHEN l_suppkey % 4 = 0 THEN 'db.junk.' WHEN l_suppkey % 4 = 1 THEN 'sales.' WHEN l_suppkey % 4 = 2 THEN 'x.temp_' ELSE 'plain' END, 's', l_suppkey) AS item, l_suppkey % 4 AS kind, l_suppkey, count(*) AS query_count, count(DISTINCT l_partkey) AS column_count FROM lineitem GROUP BY ALL)
SELECT CASE WHEN kind = 0 THEN 'db' ELSE 'main' END AS database, CASE kind WHEN 0 THEN 'junk' WHEN 1 THEN 'sales' ELSE 'x' END AS schema, CASE WHEN kind = 2 THEN concat('temp_s', l_suppkey) ELSE concat('s', l_suppkey) END AS "table", item, query_count, column_count,
  round(100.0 * query_count / (SELECT max(query_count) FROM c), 2) AS priority, CASE WHEN l_suppkey % 10 = 1 THEN 'Merged' WHEN l_suppkey % 10 = 2 THEN 'Needs Review' WHEN kind IN (0, 2) THEN 'Ephemeral' ELSE 'Discovered' END AS status FROM c WHERE kind < 3""")
def scoped_inventory(spark, sf_dir):
    """Inventory rows of several merged tables with their schemas: merged, in review, discovered and ephemeral ones."""
    k = F.col("l_suppkey")
    item = F.concat(F.when(k % 4 == 0, "db.junk.").when(k % 4 == 1, "sales.").when(k % 4 == 2, "x.temp_").otherwise("plain"), F.lit("s"), k)
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("query_count"), F.count_distinct("l_partkey").alias("column_count")).withColumn("item", item)
    scope = rows.where("l_suppkey % 10 in (1, 2)").select("item", (F.col("l_suppkey") % 10 == 1).alias("merged"))
    return S.scoped_inventory(rows.select("item", "query_count"), rows.select("item", "column_count"), scope, "main")


@query(f"WITH {MAPPING}, r AS (SELECT table_key, target, name, strategy, row_number() OVER (PARTITION BY table_key, target ORDER BY confidence DESC, name) AS rn FROM m) SELECT table_key, target, name, strategy FROM r WHERE rn = 1")
def first_mappings(spark, sf_dir):
    """The surest row of each table and target."""
    rows = part_mapping(spark, sf_dir).select("table_key", "target", "name", "strategy", "confidence")
    return M.first_mappings(rows, [-F.col("confidence"), "name"]).drop("confidence")


GRAPH = """g AS (SELECT concat('Sales.', c_mktsegment) AS a, concat('wh.n', c_nationkey) AS b, count(*) AS weight FROM customer GROUP BY ALL)"""


@query(f"""WITH {GRAPH}, n AS (SELECT DISTINCT b AS node FROM g WHERE a = 'Sales.MACHINERY')
SELECT 'Sales.MACHINERY' AS node, 'centre' AS role, '' AS reason UNION ALL SELECT node, CASE WHEN node LIKE '%7' THEN 'broken' ELSE 'neighbour' END, '' FROM n""")
def node_neighbourhood(spark, sf_dir):
    """The neighbourhood of a table whose name is given with quotes and in another case, with tables that a manifest lacks."""
    edges = read(spark, sf_dir, "customer").groupBy(F.concat(F.lit("Sales."), "c_mktsegment").alias("a"), F.concat(F.lit("wh.n"), F.col("c_nationkey")).alias("b")).agg(F.count("*").alias("weight"))
    broken = edges.select(F.col("b").alias("node")).where("node like '%7'")
    nodes, _, reason = G.neighbourhood_of(edges, " db.[sales].machinery ", broken)
    return nodes.withColumn("reason", F.lit(reason))


@query(r"""WITH o AS (SELECT o_orderkey, concat(o_orderstatus, ', ;| ', o_orderpriority, ' -') AS dom, concat('DB.', o_orderstatus, '.', o_custkey) AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 100 END AS score FROM orders)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(dom, '[\s,;|]+', '-', 'g'), '-+', '-', 'g'), '-') AS label, concat('table-', replace(lower(name), '.', '-')) AS table_label,
  CASE WHEN score >= 80 THEN 'Highest' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS band, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS short_band,
  concat(lower(split_part(name, '.', 2)), '.', split_part(name, '.', 3)) AS manifest_key, concat(split_part(name, '.', 2), ' | x y') AS one_line FROM o""")
def text_labels(spark, sf_dir):
    """Labels, bands, manifest keys and single lines of texts put together from orders."""
    o = read(spark, sf_dir, "orders")
    domain = F.concat("o_orderstatus", F.lit(", ;| "), "o_orderpriority", F.lit(" -"))
    name = F.concat(F.lit("DB."), "o_orderstatus", F.lit("."), "o_custkey")
    quoted = F.concat(F.lit('DB.['), "o_orderstatus", F.lit(']."'), "o_custkey", F.lit('"'))
    score = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise((F.col("o_custkey") % 100).cast("string"))
    text = F.concat(F.lit(" \r\n "), "o_orderstatus", F.lit("\t\r\r\n\n  x   y \n "))
    return o.select("o_orderkey", T.label(domain).alias("label"), T.table_label(name).alias("table_label"), T.band(score).alias("band"), T.short_band(score).alias("short_band"), T.manifest_key(quoted).alias("manifest_key"), T.one_line(text).alias("one_line"))


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS ascii, count(*) FILTER (WHERE c_custkey % 3 = 0) AS other, count(*) AS total FROM customer GROUP BY c_nationkey")
def name_summaries(spark, sf_dir):
    """How many of a nation's names are ASCII; every third name gets a letter that isn't."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("é"))).otherwise(F.col("c_name"))
    lists = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(name).alias("names"))
    return lists.select("c_nationkey", T.ascii_names(F.col("names")).alias("s")).select("c_nationkey", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("ascii", "other", "total")))


@query("SELECT CASE WHEN length(text) + 11 > 2000 THEN 'line over 2000 characters' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT translate(text, chr(34) || chr(92) || chr(10) || chr(13) || chr(9) || chr(0), '      ') AS text FROM documents WHERE text IS NOT NULL) d GROUP BY 1")
def long_lines(spark, sf_dir):
    """Lines of a log that are too long go to the dead letters, the others are read."""
    folder = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    plain = F.translate("text", '"\\\n\r\t\0', "      ")
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit('{"sql": "'), plain, F.lit('"}')).alias("value"))
    docs.write.option("compression", "none").text(folder)
    every = logs.all_lines(spark, folder, "*.txt")
    letters = logs.too_long(every, "ingest", "run-1", 2000).select(F.col("error_reason").alias("reason"))
    kept = logs.lines(spark, folder, "*.txt", 2000).select(F.lit("kept").alias("reason"))
    return letters.union(kept).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT origin, channel, count(*) AS n FROM (SELECT 'chat' AS origin, role AS channel, text FROM conversations UNION ALL SELECT 'notes', NULL, text FROM documents) m WHERE text <> '' GROUP BY ALL")
def messages_of_readers(spark, sf_dir):
    """Messages of two readers in one table, each with its source."""
    folder = f"{scratch_dir(spark)}/messages-{uuid.uuid4().hex}"
    read(spark, sf_dir, "conversations").select(F.to_json(F.struct("text", F.col("role").alias("channel"))).alias("value")).write.text(f"{folder}/chat")
    read(spark, sf_dir, "documents").where("text is not null").select(F.to_json(F.struct(F.col("text").alias("body"))).alias("value")).write.text(f"{folder}/notes")
    both = logs.combined(logs.read_messages(spark, f"{folder}/chat", "*.txt"), logs.read_messages(spark, f"{folder}/notes", "*.txt"), labels=["chat", "notes"])
    return both.groupBy("origin", "channel").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_partkey AS card, CASE p_partkey % 6 WHEN 0 THEN 'glossary_source' ELSE 'confirmed' END AS kind, p_type AS domain, p_brand, p_size AS confidence, p_partkey % 6 AS k FROM part),
i AS (SELECT DISTINCT p_brand AS "table", CASE WHEN p_brand < 'Brand#2' THEN 'Sales' ELSE 'Ops' END AS domain, CASE WHEN p_brand LIKE '%1' THEN 'North' WHEN p_brand LIKE '%2' THEN 'South' END AS portfolio FROM part)
SELECT card FROM c LEFT JOIN i ON i."table" = c.p_brand WHERE confidence >= 10 AND (k = 0 OR (k = 1 AND c.domain = 'Sales') OR (k > 1 AND i.domain = 'Sales' AND coalesce(portfolio, 'North') = 'North'))""")
def cards_by_scope(spark, sf_dir):
    """Cards by confidence, domain and portfolio of their tables: entries of the glossary's source, cards without tables, and others."""
    part = read(spark, sf_dir, "part")
    k, brand = F.col("p_partkey") % 6, F.col("p_brand")
    tables = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("none"), F.lit(" "), brand)).otherwise(F.array(brand))
    cards = part.select(F.col("p_partkey").alias("card"), F.when(k == 0, "glossary_source").otherwise("confirmed").alias("kind"), F.col("p_type").alias("domain"), tables.alias("tables"), F.col("p_size").alias("confidence"))
    portfolio = F.when(brand.endswith("1"), "North").when(brand.endswith("2"), "South")
    inventory = part.select(brand.alias("table"), F.when(brand < "Brand#2", "Sales").otherwise("Ops").alias("domain"), portfolio.alias("portfolio")).distinct()
    return R.cards_by_scope(cards, inventory, 10, ["Sales"], "North").select("card")


@query("""SELECT 'matrix' AS kind, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'hotspots', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT 'all', count(*) FROM orders UNION ALL SELECT 'none', 0""")
def scope_filters(spark, sf_dir):
    """Matrix rows by domain, and rows by allowed tables: some, all, and none."""
    orders = read(spark, sf_dir, "orders")
    matrix = R.in_domains(S.domain_matrix(orders, "o_orderpriority", "o_totalprice", "o_orderstatus"), ["1-URGENT", "5-LOW"])
    allowed = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("table"))
    found = {"matrix": matrix, "hotspots": R.in_tables(orders, allowed, "o_custkey"), "all": R.in_tables(orders, None, "o_custkey"), "none": R.in_tables(orders, allowed.limit(0), "o_custkey")}
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in found.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("SELECT o_orderpriority AS domain, count(*) AS tables, count(DISTINCT o_orderstatus) AS schemas, round(100.0 * sum(o_totalprice) / (SELECT max(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_orderpriority) x), 2) AS scaled, round(avg(o_custkey), 2) AS mean_complexity FROM orders GROUP BY o_orderpriority")
def domain_complexity(spark, sf_dir):
    return S.domain_matrix(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey")


@query("""WITH p AS (SELECT user_id AS item, event_type AS peer, count(*) AS weight FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, peer) AS rn FROM p)
SELECT item, peer, weight FROM r WHERE rn <= 3""")
def merged_peers(spark, sf_dir):
    """The strongest peers of two runs together."""
    events = read(spark, sf_dir, "events")
    halves = [events.where(F.col("event_id") % 2 == i).groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("peer")).agg(F.count("*").alias("weight")) for i in (0, 1)]
    return B.merge_peers(*halves, most=3)


@query("WITH r AS (SELECT lower(props) AS key, ts, event_id, row_number() OVER (PARTITION BY lower(props) ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT key, event_id FROM r WHERE rn = 1 ORDER BY ts DESC, event_id DESC, key LIMIT 60")
def newest_per_key(spark, sf_dir):
    """The newest event of each text, the newest sixty of all."""
    rows = read(spark, sf_dir, "events").select("ts", "event_id", "props")
    return B.first_per_key(rows, F.lower("props"), ["ts", "event_id"], 60).select("key", "event_id")


@query("""WITH o AS (SELECT o_orderkey % 4 AS k, lower(o_orderstatus) AS s FROM orders)
SELECT 'סכום' AS token, concat('amount_', s) AS follower, count(*) AS n FROM o WHERE k IN (0, 3) GROUP BY ALL UNION ALL SELECT 'שם_לקוח', 'name', count(*) FROM o WHERE k = 3""")
def mined_pairs(spark, sf_dir):
    """Hebrew columns directly followed by columns of the catalog in statements of four kinds."""
    o = read(spark, sf_dir, "orders")
    amount = F.concat(F.lit("amount_"), F.lower("o_orderstatus"))
    text = F.element_at(F.array(
        F.concat(F.lit("SELECT [סכום], "), amount, F.lit(" FROM s.t WHERE k = "), "o_custkey"), F.concat(F.lit("SELECT [סכום], order_id, "), amount, F.lit(" FROM s.t")),
        F.concat(F.lit("SELECT "), amount, F.lit(", [סכום], other FROM s.t")), F.concat(F.lit("SELECT [שם לקוח], Name, [סכום], "), amount, F.lit(" FROM s.t")),
    ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    catalog = o.select(amount.alias("col")).union(o.select(F.lit("NAME"))).union(o.select(F.lit("order_id"))).distinct()
    return X.mined_pairs(o.select(F.col("o_orderkey").alias("stmt"), text.alias("sql")), catalog)


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 < 2) AS kept, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS skipped, count(*) FILTER (WHERE o_orderkey % 3 < 2) AS written FROM orders")
def schema_filter_counts(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "SELECT a FROM sales.t").when(k == 1, "SELECT a FROM [CRM].t").otherwise("SELECT a FROM presales.t")
    kept, seen = catalogs.of_schemas(read(spark, sf_dir, "orders").select(text.alias("sql")), ["sales", "crm"])
    return kept.agg(*(F.lit(seen[n]).cast("long").alias(n) for n in ("kept", "skipped")), F.count("*").alias("written"))


@query("SELECT o_orderkey, upper(o_orderstatus) AS found, o_totalprice / 1000 AS score FROM orders WHERE o_orderstatus = 'F'")
def hooked_source(spark, sf_dir):
    """A run whose source is a user's own function."""
    source = lambda s: read(s, sf_dir, "orders").where("o_orderstatus = 'F'")
    own = lambda df: df.select("o_orderkey", F.upper("o_orderstatus").alias("found"), "o_totalprice")
    return R.run_with_hooks(spark, source, own, lambda df: df["o_totalprice"] / 1000).drop("o_totalprice")


@query(f"WITH {MAPPING} SELECT table_key, target, string_agg(concat(name, '→', target, ': ', strategy, ', ', printf('%.6f', confidence)), '; ' ORDER BY concat(name, '→', target, ': ', strategy, ', ', printf('%.6f', confidence))) AS citations FROM m WHERE bucket = 'merged' GROUP BY 1, 2")
def mapping_citations(spark, sf_dir):
    """Which names each merged column stands for, and why."""
    return M.citations(part_mapping(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT item, domain, queue, status, confidence, criticality FROM sc WHERE (contains(lower(item), 'r.c1') OR contains(lower(domain), 'r.c1')) AND queue IN ('green', 'yellow')
  AND k % 10 <> 4 AND confidence >= 20 AND criticality <= 80 ORDER BY confidence DESC, item LIMIT 40""")
def table_search(spark, sf_dir):
    """An interactive search: text in two columns, queues, bounds, rows that are done left out, the surest forty."""
    rows, _ = scored_tables(spark, sf_dir)
    done = read(spark, sf_dir, "customer").where("c_custkey % 10 = 4").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "CRM.").when(F.col("c_custkey") % 3 == 1, "hr.").otherwise(""), F.lit("c"), "c_custkey").alias("item"))
    return L.table_search(rows, "R.C1", ("item", "domain"), None, ["green", "yellow"], done, 20, 80, "confidence", True, 40)


ORDER_NAMES = [("o_orderkey", "מספר_הזמנה"), ("o_custkey", "קוד_לקוח"), ("o_totalprice", "סכום"), ("o_orderstatus", "סטטוס")]
CUSTOMER_NAMES = [("c_custkey", "קוד_לקוח"), ("c_name", "שם_לקוח"), ("c_mktsegment", "מגזר")]


@query("SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment")
def renamed_views_joined(spark, sf_dir):
    """Two views with Hebrew names joined to each other and grouped."""
    R.renamed(read(spark, sf_dir, "orders"), ORDER_NAMES).createOrReplaceTempView("renamed_orders")
    R.renamed(read(spark, sf_dir, "customer"), CUSTOMER_NAMES).createOrReplaceTempView("renamed_customers")
    return spark.sql("SELECT c.`מגזר` AS segment, count(*) AS orders, round(sum(o.`סכום`), 2) AS total FROM renamed_orders o JOIN renamed_customers c ON c.`קוד_לקוח` = o.`קוד_לקוח` WHERE o.`סטטוס` <> 'P' GROUP BY c.`מגזר`")


@query("SELECT c_custkey AS customer_id, o.orders, o.top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey WHERE o.orders IS NULL OR o.orders > 12")
def renamed_view_outer(spark, sf_dir):
    """A base table joined to an aggregate of a view with Hebrew names, customers without orders kept."""
    R.renamed(read(spark, sf_dir, "orders"), ORDER_NAMES).createOrReplaceTempView("renamed_orders")
    read(spark, sf_dir, "customer").createOrReplaceTempView("base_customer")
    return spark.sql("SELECT c_custkey AS customer_id, o.orders, o.top FROM base_customer LEFT JOIN (SELECT `קוד_לקוח` AS k, count(*) AS orders, max(`סכום`) AS top FROM renamed_orders GROUP BY `קוד_לקוח`) o ON o.k = c_custkey WHERE o.orders IS NULL OR o.orders > 12")
