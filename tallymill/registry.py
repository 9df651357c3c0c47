"""Queries of the library's own operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import baskets as B
from .operators import extract as X
from .operators import graph as G
from .operators import scoring as S
from .plans.scratch import materialize, scratch_dir
from .register import ORACLE_SQL, QUERIES, query, read  # noqa: F401
from .sources import logs
from .streaming import counts as C


def order_suppliers(spark, sf_dir) -> DataFrame:
    return B.baskets(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def supplier_touches(spark, sf_dir) -> DataFrame:
    return B.touches(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def supplier_edges(spark, sf_dir) -> DataFrame:
    return B.pair_weights(supplier_touches(spark, sf_dir), repeats=True)


BASKETS = "b AS (SELECT DISTINCT l_orderkey AS stmt, l_suppkey AS item FROM lineitem WHERE l_suppkey IS NOT NULL)"
EDGES = BASKETS + ", e AS (SELECT x.item AS a, y.item AS b, least(count(*), 10000) AS weight FROM b AS x JOIN b AS y ON x.stmt = y.stmt AND x.item < y.item GROUP BY x.item, y.item)"
SYM = EDGES + ", s AS (SELECT a AS src, b AS dst, weight FROM e UNION ALL SELECT b, a, weight FROM e)"
DEGREE = SYM + ", d AS (SELECT src AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM s GROUP BY src)"
COUNTS = BASKETS + ", c AS (SELECT item, count(*) AS query_count FROM b GROUP BY item)"


@query(f"WITH {COUNTS} SELECT * FROM c")
def statement_table_counts(spark, sf_dir):
    return B.table_counts(order_suppliers(spark, sf_dir))


@query(f"WITH {EDGES} SELECT a, b, weight FROM e ORDER BY weight DESC, a, b LIMIT 60000")
def co_occurrence_edges(spark, sf_dir):
    return B.strongest(supplier_edges(spark, sf_dir))


@query(f"WITH {EDGES}, n AS (SELECT count(DISTINCT item) AS tables FROM b), p AS (SELECT count(*) AS pairs FROM e) SELECT tables, pairs, 2.0 * pairs / (tables * (tables - 1)) AS density FROM n, p")
def co_occurrence_summary(spark, sf_dir):
    return B.summary(order_suppliers(spark, sf_dir))


@query(f"WITH {SYM}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM s) SELECT src AS item, count(*) AS n_peers, CAST(sum(weight) AS BIGINT) AS peer_weight, min(CASE WHEN rn = 1 THEN dst END) AS best_peer FROM r GROUP BY src")
def co_peers(spark, sf_dir):
    return B.co_peers(supplier_edges(spark, sf_dir))


@query("SELECT event_id, user_id FROM events WHERE coalesce(trim(event_type), '') = '' OR lower(trim(event_type)) = 'click'")
def environment_filter(spark, sf_dir):
    return B.environment(read(spark, sf_dir, "events"), "event_type", "CLICK").select("event_id", "user_id")


ROLES = ["click", "purchase", "view", "signup"]


@query("SELECT user_id AS item, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{r}') AS \"{r}\"" for r in ROLES) + " FROM events GROUP BY user_id")
def role_counts(spark, sf_dir):
    return B.role_counts(read(spark, sf_dir, "events"), "user_id", "event_type", ROLES)


@query(ORACLE_SQL["role_counts"])
def merged_role_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    halves = [B.role_counts(rows.where(F.col("event_id") % 2 == i), "user_id", "event_type", ROLES) for i in (0, 1)]
    return B.merge_counts(*halves, keys=["item"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE e) AS skipped_empty, count(*) FILTER (WHERE o AND NOT e) AS env_mismatch, count(*) FILTER (WHERE NOT o AND NOT e) AS parse_ok FROM (SELECT coalesce(trim(props), '') = '' AS e, coalesce(event_type <> '' AND event_type <> 'click', false) AS o FROM events) x")
def ingestion_telemetry(spark, sf_dir):
    return B.telemetry(read(spark, sf_dir, "events"), F.col("props"), F.col("event_type"), "click")


ADJACENT = "p AS (SELECT token, follower, count(*) AS n FROM (SELECT event_type AS token, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS follower FROM events) x WHERE follower IS NOT NULL AND token IS NOT NULL GROUP BY token, follower)"
RANKED = ADJACENT + ", r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY token ORDER BY n DESC, follower) AS INTEGER) AS rank FROM p WHERE n >= 3) y WHERE rank <= 3)"


def event_pairs(spark, sf_dir):
    return B.adjacent_pairs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {ADJACENT} SELECT * FROM p")
def adjacent_pairs(spark, sf_dir):
    return event_pairs(spark, sf_dir)


@query(f"WITH {RANKED} SELECT token, rank, follower, n FROM r")
def top_candidates(spark, sf_dir):
    return B.candidates(event_pairs(spark, sf_dir))


@query(f"WITH {RANKED} SELECT token, min(CASE WHEN rank = 1 THEN follower END) AS target, max(n) AS n, count(*) - 1 AS alternatives, least(0.95, 0.3 + 0.65 * max(n) / (SELECT max(n) FROM r)) AS confidence FROM r GROUP BY token")
def glossary_candidates(spark, sf_dir):
    return B.glossary(event_pairs(spark, sf_dir))


@query(f"WITH {SYM} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM s GROUP BY 1, 2")
def undirected_adjacency(spark, sf_dir):
    return G.adjacency(G.symmetric(supplier_edges(spark, sf_dir)))


@query(f"WITH {EDGES}, t AS (SELECT * FROM e ORDER BY weight DESC, a, b LIMIT 4000) SELECT a AS src, b AS dst, weight, 'coquery' AS kind FROM t UNION ALL SELECT b, a, weight, 'coquery' FROM t")
def edge_export(spark, sf_dir):
    return G.export(supplier_edges(spark, sf_dir))


@query(f"WITH {SYM}, n AS (SELECT dst AS node FROM s WHERE src = 7 UNION SELECT 7) SELECT a AS src, b AS dst, weight, CASE WHEN a = 7 OR b = 7 THEN 'spoke' ELSE 'rim' END AS role FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)")
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(supplier_edges(spark, sf_dir), 7)


@query(f"WITH {DEGREE} SELECT * FROM d")
def node_degree(spark, sf_dir):
    return G.degree(supplier_edges(spark, sf_dir))


PARTS = "b AS (SELECT DISTINCT l_orderkey AS stmt, l_partkey AS item FROM lineitem), e AS (SELECT x.item AS a, y.item AS b, least(count(*), 10000) AS weight FROM b AS x JOIN b AS y ON x.stmt = y.stmt AND x.item < y.item GROUP BY x.item, y.item)"


@query(
    f"""WITH RECURSIVE {PARTS}, st AS (SELECT * FROM e WHERE weight >= 3), s AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
reach AS (SELECT DISTINCT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON s.a = r.other),
root AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
o AS (SELECT i.item AS node, coalesce(root.cluster, i.item) AS cluster FROM (SELECT DISTINCT item FROM b) i LEFT JOIN root ON root.node = i.item),
w AS (SELECT root.cluster, CAST(sum(weight) AS BIGINT) AS internal_weight FROM st JOIN root ON root.node = st.a GROUP BY root.cluster)
SELECT o.cluster, count(*) AS size, coalesce(max(w.internal_weight), 0) AS internal_weight FROM o LEFT JOIN w ON w.cluster = o.cluster GROUP BY o.cluster ORDER BY 3 DESC, 2 DESC, 1"""
)
def connected_clusters(spark, sf_dir):
    b = B.touches(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return G.clusters(b.select(F.col("item").alias("node")), B.pair_weights(b, repeats=True), least=3)


FACTS = "f AS (SELECT s_suppkey AS node, s_nationkey AS domain, round(abs(s_acctbal) / 100, 4) AS priority FROM supplier)"


@query(
    f"""WITH {DEGREE}, {FACTS}, k AS (SELECT node AS seed, priority FROM f WHERE priority >= 10),
h1 AS (SELECT DISTINCT seed, dst AS node FROM k JOIN s ON s.src = k.seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN s ON s.src = h1.node),
h3 AS (SELECT DISTINCT seed, dst AS node FROM h2 JOIN s ON s.src = h2.node),
r AS (SELECT seed, seed AS node FROM k UNION SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3),
t AS (SELECT r.seed, count(*) AS reach, count(DISTINCT f.domain) AS spread FROM r JOIN f ON f.node = r.node GROUP BY r.seed)
SELECT t.seed, reach, spread, round(least(100.0, 22.0 * spread + 2.5 * reach + 0.15 * k.priority), 4) AS score FROM t JOIN k ON k.seed = t.seed LEFT JOIN d ON d.node = t.seed
WHERE spread >= 2 OR reach >= 4 OR (spread >= 1 AND reach >= 3) OR (reach >= 2 AND coalesce(d.degree, 0) > 0) ORDER BY score DESC, t.seed LIMIT 30"""
)
def blast_radius(spark, sf_dir):
    facts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("domain"), F.round(F.abs("s_acctbal") / 100, 4).alias("priority"))
    return G.blast_radius(supplier_edges(spark, sf_dir), facts)


@query(f"WITH {SYM}, n AS (SELECT src, sqrt(sum(weight * weight)) AS norm FROM s GROUP BY src), p AS (SELECT x.src AS a, y.src AS b, count(*) AS shared, sum(x.weight * y.weight) AS dot FROM s x JOIN s y ON x.dst = y.dst AND x.src < y.src GROUP BY x.src, y.src) SELECT a, b, shared, round(dot / (na.norm * nb.norm), 6) AS cosine FROM p JOIN n na ON na.src = a JOIN n nb ON nb.src = b")
def table_similarity(spark, sf_dir):
    return G.similarity(materialize(supplier_edges(spark, sf_dir)), summed=True)


@query(f"WITH {SYM} SELECT src AS node, count(*) AS broken FROM s WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY src")
def broken_references(spark, sf_dir):
    listed = read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("node"))
    return G.outside(supplier_edges(spark, sf_dir), listed)


INVENTORY = COUNTS + ", k AS (SELECT l_suppkey AS item, count(DISTINCT l_partkey) AS column_count, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS confirmed FROM lineitem GROUP BY l_suppkey)"


def supplier_inventory(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"))
    k = rows.agg(F.count_distinct("l_partkey").alias("column_count"), F.count_distinct(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("confirmed"))
    return S.inventory(statement_table_counts(spark, sf_dir), k.select("item", "column_count"), k.select("item", "confirmed"))


@query(f"WITH {INVENTORY} SELECT c.item, query_count, column_count, round(100.0 * query_count / (SELECT max(query_count) FROM c), 2) AS priority, CASE WHEN column_count = 0 THEN 'Empty' WHEN confirmed = 0 THEN 'Discovered' WHEN confirmed < column_count THEN 'Needs Review' ELSE 'Ready' END AS status FROM c JOIN k ON k.item = c.item")
def inventory_rows(spark, sf_dir):
    return supplier_inventory(spark, sf_dir)


@query(f"WITH {COUNTS} SELECT item, query_count, CAST(row_number() OVER (ORDER BY query_count DESC, item) AS INTEGER) AS rank FROM c ORDER BY query_count DESC, item LIMIT 25")
def activity_rank(spark, sf_dir):
    return S.activity_rank(statement_table_counts(spark, sf_dir), 25)


USAGE = "u AS (SELECT user_id AS item, event_type AS name, count(*) FILTER (WHERE value > 20) AS uses, count(*) FILTER (WHERE value > 50) AS mentions, count(*) FILTER (WHERE value > 80) AS files FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {USAGE}, w AS (SELECT *, max(uses) OVER (PARTITION BY item) AS top, greatest(count(*) FILTER (WHERE uses > 0) OVER (PARTITION BY item), 1) AS used, sum(mentions) OVER (PARTITION BY item) AS sm, sum(files) OVER (PARTITION BY item) AS sf FROM u),
x AS (SELECT item, name, CASE WHEN top > 0 THEN 1.0 * uses / top ELSE 0.0 END AS lw, sm / (10.0 + sm) * CASE WHEN uses > 0 THEN 1.0 ELSE 0.25 END / used AS cw, sf / (10.0 + sf) * CASE WHEN uses > 0 THEN 1.0 ELSE 0.25 END / used AS gw, uses = 0 AS dead FROM w)
SELECT item, name, round(lw, 6) AS log_weight, round(cw, 6) AS comms_weight, round(gw, 6) AS git_weight, round(lw + 0.15 * cw + 0.1 * gw, 6) AS score, dead FROM x"""
)
def column_importance(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("name"))
    return S.importance(e.agg(F.count_if(F.col("value") > 20).alias("uses"), F.count_if(F.col("value") > 50).alias("mentions"), F.count_if(F.col("value") > 80).alias("files")))


CRITICAL = "x AS (SELECT c.item, CASE WHEN coalesce(degree, 0) >= 10 THEN 40 WHEN coalesce(degree, 0) >= 5 THEN 25 WHEN coalesce(degree, 0) >= 1 THEN 15 ELSE 0 END AS lineage, CASE WHEN query_count >= 1000 THEN 35 WHEN query_count >= 500 THEN 30 WHEN query_count >= 200 THEN 20 WHEN query_count >= 50 THEN 10 ELSE 0 END AS usage, CASE WHEN c.item % 10 = 0 THEN 25 ELSE 0 END AS naming FROM c LEFT JOIN d ON d.node = c.item)"
DEGREE_COUNTS = DEGREE + ", c AS (SELECT item, count(*) AS query_count FROM b GROUP BY item)"


@query(f"WITH {DEGREE_COUNTS}, {CRITICAL} SELECT *, least(lineage + usage + naming, 100) AS criticality FROM x")
def criticality_score(spark, sf_dir):
    return S.criticality(statement_table_counts(spark, sf_dir), node_degree(spark, sf_dir), F.col("item") % 10 == 0)


@query("WITH q AS (SELECT c_mktsegment, CASE WHEN c_custkey % 100 >= 80 OR c_acctbal < 0 OR c_nationkey * 4 < 20 THEN 'red' WHEN c_nationkey * 4 < 60 OR c_acctbal < 1000 THEN 'yellow' WHEN c_custkey % 100 <= 50 THEN 'green' ELSE 'yellow' END AS queue FROM customer) SELECT c_mktsegment, count(*) FILTER (WHERE queue = 'red') AS red, count(*) FILTER (WHERE queue = 'yellow') AS yellow, count(*) FILTER (WHERE queue = 'green') AS green, count(*) AS total FROM q GROUP BY c_mktsegment")
def queue_rollup(spark, sf_dir):
    scored = read(spark, sf_dir, "customer").withColumn("queue", S.queue(F.col("c_nationkey") * 4 + 50, F.col("c_custkey") % 100, F.col("c_acctbal") < 0, F.col("c_acctbal") < 1000, floor=110))
    return S.queue_counts(scored, "c_mktsegment")


@query("WITH t AS (SELECT o_orderpriority AS domain, count(*) AS tables, count(DISTINCT o_orderstatus) AS schemas, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT domain, tables, schemas, round(100.0 * total / (SELECT max(total) FROM t), 2) AS scaled FROM t")
def domain_matrix(spark, sf_dir):
    return S.domain_matrix(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus")


@query("WITH m AS (SELECT p_brand, avg(p_size) AS mean, stddev_pop(p_size) AS deviation FROM part GROUP BY p_brand) SELECT p_partkey, part.p_brand, p_size FROM part JOIN m ON m.p_brand = part.p_brand WHERE p_size > mean + 1.5 * deviation")
def width_outliers(spark, sf_dir):
    return S.width_outliers(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size", 1.5)


@query(
    """WITH n AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
c AS (SELECT DISTINCT p_brand, (n - 1) // 20 AS chunk FROM n), f AS (SELECT p_brand, p_retailprice, p_partkey FROM n WHERE n = 1),
w AS (SELECT c.p_brand, chunk, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey, chunk) AS wave FROM c JOIN f ON f.p_brand = c.p_brand)
SELECT p_partkey, n.p_brand, CAST(wave AS INTEGER) AS wave FROM n JOIN w ON w.p_brand = n.p_brand AND w.chunk = (n.n - 1) // 20 WHERE wave <= 50"""
)
def planning_waves(spark, sf_dir):
    return part_waves(spark, sf_dir, 50)


def part_waves(spark, sf_dir, most: int | None) -> DataFrame:
    parts = read(spark, sf_dir, "part").withColumn("down", -F.col("p_retailprice"))
    return S.waves(parts, "p_brand", ["down", "p_partkey"], per_wave=20, most=most).select("p_partkey", "p_brand", "wave")


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN least(greatest(d.n_chars / 10000.0, 0.85), 0.98) ELSE d.n_chars / 10000.0 END AS confidence, CASE WHEN l.quality = 1 THEN 'merged' WHEN l.quality = 0 THEN 'trash' ELSE 'review' END AS bucket FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def review_decisions(spark, sf_dir):
    chosen = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "reject").alias("action"))
    return S.decisions(read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10000.0).alias("confidence")), chosen, "doc_id")


@query("SELECT l.quality, d.source, count(*) AS n, round(100.0 * avg(CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END), 2) AS clean FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality, d.source")
def domain_health(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("quality", "source").agg(F.count("*").alias("n"), F.round(100.0 * F.avg((F.col("toxic") == 0).cast("int")), 2).alias("clean"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '_')) AS name, CASE WHEN c_acctbal >= 80 THEN 'Highest' WHEN c_acctbal >= 60 THEN 'High' WHEN c_acctbal >= 40 THEN 'Medium' ELSE 'Low' END AS band FROM customer")
def names_and_bands(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.normalize_name(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("name"), T.band(F.col("c_acctbal")).alias("band"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS dedupe FROM part")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_type")).alias("slug"), T.dedupe_key(F.col("p_name")).alias("dedupe"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(1.0 * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text), 4) ELSE 1.0 END AS ratio FROM documents")
def ascii_share(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.ascii_ratio(F.col("text")).alias("ratio"))


@query(
    r"""WITH e AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.([A-Za-z]{2,})', '\1***@***.\2', 'g') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(t, '\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b', '**** **** **** ****', 'g') AS t FROM e),
i AS (SELECT doc_id, regexp_replace(t, '^\s*\d{9}\s*$', '*********') AS t FROM c)
SELECT doc_id, regexp_replace(t, '\b0\d{1,2}[- ]?\d{3}[- ]?\d{4}\b', '***-***-****', 'g') AS masked FROM i"""
)
def pii_masking(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


@query(
    """SELECT doc_id, CAST(2 * ((length(low) - length(replace(low, 'the', ''))) // 3) + 3 * ((length(low) - length(replace(low, 'of.the', ''))) // 6)
  + CASE WHEN regexp_matches(low, '(^|[^_\\p{L}\\p{N}])the($|[^_\\p{L}\\p{N}])') THEN 1 ELSE 0 END AS BIGINT) AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) d"""
)
def mention_scores(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.mention_score(F.col("text"), "of", "the").cast("long").alias("score"))


@query(
    r"""SELECT o_orderkey, concat('SELECT 1 FROM t WHERE k = <N> AND s = ''<REDACTED>'' AND id IN (<N>, <N>) AND d in ( <N>) AND f(', o_custkey, ') > <N>') AS redacted FROM orders"""
)
def literal_redaction(spark, sf_dir):
    parts = ["SELECT 1 FROM t WHERE k = ", F.col("o_custkey"), " AND s = '", F.col("o_orderstatus"), "' AND id IN (", F.col("o_custkey"), ", -12) AND d in ( ", F.col("o_custkey"), ") AND f(", F.col("o_custkey"), ") > -1.5"]
    sql = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.redact(sql).alias("redacted"))


def statement_log(spark, sf_dir):
    """A log with a statement for each order, put together from its columns."""
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("SELECT o.id, c.name FROM sales."), F.lower("o_orderstatus"), F.lit("_orders AS o JOIN crm.customers c ON o.cust = c.id WHERE o.prio = "), F.substring("o_orderpriority", 1, 1), F.lit(" GROUP BY o.id ORDER BY c.name"))
    return o.select(F.col("o_orderkey").alias("stmt"), text.alias("sql"))


@query("SELECT table_key, n FROM (SELECT concat('sales.', lower(o_orderstatus), '_orders') AS table_key, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'crm.customers', count(*) FROM orders) x")
def extracted_tables(spark, sf_dir):
    return X.table_refs(statement_log(spark, sf_dir)).groupBy("table_key").agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT concat('sales.', lower(o_orderstatus), '_orders') AS o, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n FROM k)
SELECT o AS table_key, role, name, n FROM k, (VALUES ('select', 'id'), ('join_on', 'cust'), ('where', 'prio'), ('group_by', 'id')) v(role, name)
UNION ALL SELECT 'crm.customers', role, name, CAST(n AS BIGINT) FROM t, (VALUES ('select', 'name'), ('join_on', 'id'), ('order_by', 'name')) v(role, name)"""
)
def extracted_columns(spark, sf_dir):
    log = statement_log(spark, sf_dir)
    return X.column_refs(log).groupBy("table_key", "role", "name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS valid, count(DISTINCT user_id) AS users, 0 AS skipped FROM events")
def jsonl_round_trip(spark, sf_dir):
    folder = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("props").alias("sql"), F.col("event_type").alias("env"), F.col("user_id").alias("batch_id"))).alias("value"))
    events.withColumn("value", F.concat("value", F.lit(chr(0)))).write.option("compression", "none").text(f"{folder}/sql_logs")
    rows = logs.parse_log(logs.lines(spark, folder, "*.txt"))
    return rows.agg(F.count_if(F.col("corrupt").isNull()).alias("valid"), F.count_distinct("batch_id").alias("users"), F.count_if(F.col("corrupt").isNotNull()).cast("int").alias("skipped"))


@query("SELECT event_type AS item, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    return C.drain(C.counts(C.read_table(spark, sf_dir, "events"), "event_type", "value"), ["item"])


@query("SELECT date_trunc('day', ts) AS day, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    rows = C.drain(C.windowed(C.read_table(spark, sf_dir, "events"), "ts", "event_type"), ["w", "item"])
    return rows.select(F.col("w.start").alias("day"), "item", "n")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_users(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def except_users(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("user_id").subtract(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def keep_first(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(T.dedupe_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT text AS message, count(*) AS n, count(DISTINCT origin) AS origins FROM (SELECT text, 'conversation' AS origin FROM conversations UNION ALL SELECT text, 'document' FROM documents) m GROUP BY text HAVING count(*) > 1")
def combined_messages(spark, sf_dir):
    both = read(spark, sf_dir, "conversations").select("text", F.lit("conversation").alias("origin")).union(read(spark, sf_dir, "documents").select("text", F.lit("document").alias("origin")))
    return both.groupBy(F.col("text").alias("message")).agg(F.count("*").alias("n"), F.count_distinct("origin").alias("origins")).where("n > 1")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c WHERE rn = 1")
def last_turns(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return read(spark, sf_dir, "conversations").withColumn("rn", rank).where("rn = 1").select("conv_id", "turn", "text")
