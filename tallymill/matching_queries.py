"""Queries of substring joins, leader clusters, running states and incremental loads, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import extract as X
from .operators import incremental as I
from .operators import leaders as L
from .operators import substring as U
from .plans.scratch import scratch_dir
from .register import query, read
from .streaming import counts as C
from .streaming import status as J


@query("""
WITH t AS (SELECT DISTINCT lower(p_name) AS text FROM part),
n AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT substr(p_name, 2, 2) FROM part UNION ALL SELECT p_brand FROM part) x)
SELECT name, text FROM n JOIN t ON contains(text, name)""")
def terms_with_names(spark, sf_dir):
    """Part names as terms of a glossary, with the words, pairs of letters and brands that stand inside them."""
    part = read(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("name"))
    names = words.union(part.select(F.substring("p_name", 2, 2))).union(part.select("p_brand"))
    return U.pairs(part, names, "p_name", "name")


@query("""
WITH n AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT left(event_type, 4) FROM events) x WHERE w <> ''),
t AS (SELECT DISTINCT lower(text) AS text FROM documents)
SELECT name FROM n WHERE EXISTS (SELECT 1 FROM t WHERE contains(t.text, n.name))""")
def names_in_documents(spark, sf_dir):
    """Words of part names, and beginnings of event types, that stand anywhere in the whole texts of documents."""
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    kinds = read(spark, sf_dir, "events").select(F.substring("event_type", 1, 4).alias("name"))
    return U.contained(read(spark, sf_dir, "documents"), words.union(kinds), "text", "name")


@query("""
WITH c AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS col FROM part), p AS (SELECT DISTINCT lower(w) AS peer FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT concat(replace(p_name, ' ', '_'), '_id') FROM part) x)
SELECT peer, col FROM p JOIN c ON contains(col, peer) OR contains(peer, col)""")
def near_peers(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    column = F.replace("p_name", F.lit(" "), F.lit("_"))
    peers = part.select(F.explode(F.split("p_name", " ")).alias("peer")).union(part.select(F.concat(column, F.lit("_id"))))
    return U.near_peers(peers, part.select(column.alias("col")))


LEADERS = """
WITH RECURSIVE v AS ({vectors}),
u AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x, row_number() OVER (ORDER BY id) AS n FROM v),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x DOUBLE[])[]) AS heads
  UNION ALL SELECT u.n, CASE WHEN len(list_filter(heads, lambda h: list_dot_product(h.x, u.x) >= 0.88)) > 0 THEN heads ELSE list_append(heads, {{'id': u.id, 'x': u.x}}) END
  FROM s JOIN u ON u.n = s.n + 1),
h AS (SELECT heads FROM s ORDER BY n DESC LIMIT 1),
k AS (SELECT u.id, list_position(list_transform(heads, lambda h: list_dot_product(h.x, u.x) >= 0.88), true) AS place, heads FROM u, h)
SELECT id AS {name}, concat('cluster_', place - 1) AS cluster, heads[place].id AS leader, CASE WHEN place = 1 THEN 'Core' ELSE 'Rest' END AS rollup FROM k"""
TAXONOMY = {"cluster_0": "Core", "default": "Rest"}


@query(LEADERS.format(name="vec_id", vectors="SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"))
def leader_clusters(spark, sf_dir):
    return L.leader_clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", taxonomy=TAXONOMY)


@query(LEADERS.format(name="custkey", vectors="""SELECT o_custkey AS id, [CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE), count(*) FILTER (o_orderpriority = '2-HIGH'), count(*) FILTER (o_orderpriority = '3-MEDIUM'),
  count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED'), count(*) FILTER (o_orderpriority = '5-LOW')] AS x FROM orders GROUP BY o_custkey"""))
def profile_clusters(spark, sf_dir):
    """Customers by what share of their orders has each priority: crowded clusters, where most rows join a leader."""
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    counts = F.array(*(F.count_if(F.col("o_orderpriority") == k).cast("double") for k in kinds)).alias("profile")
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(counts)
    return L.leader_clusters(rows, "custkey", "profile", taxonomy=TAXONOMY)


@query("SELECT user_id AS job, m.ts AS ts, m.id AS id, m.status AS status, n FROM (SELECT user_id, max({'ts': ts, 'id': event_id, 'status': event_type}) AS m, count(*) AS n FROM events GROUP BY user_id) x")
def job_status(spark, sf_dir):
    """The latest event of each user as a stream's state in update mode, micro-batches merged by partial maxima."""
    stream = C.read_table(spark, sf_dir, "events")
    return C.drain(J.latest(stream, "user_id", "ts", "event_id", "event_type"), ["job"])


@query("SELECT user_id AS job, m.ts AS ts, m.id AS id, m.status AS status FROM (SELECT user_id, max({'ts': ts, 'id': event_id, 'status': event_type}) AS m FROM events GROUP BY user_id) x")
def running_jobs(spark, sf_dir):
    """The same by keyed state with timers, for a table of which no event counts as late."""
    stream = C.read_table(spark, sf_dir, "events")
    state = J.running(stream, "user_id", "ts", "event_id", "event_type", ("purchase",), late="3650 days", keep_ms=86_400_000)
    return C.drain(state, ["job"]).select("job", "ts", "id", "status")


@query("SELECT user_id, event_type, m.ts AS ts, m.event_id AS event_id, m.value AS value, m.props AS props FROM (SELECT user_id, event_type, max({'ts': ts, 'event_id': event_id, 'value': value, 'props': props}) AS m FROM events GROUP BY user_id, event_type) x")
def incremental_load(spark, sf_dir):
    """Events merged by user and type in two increments and one that is run again; the newest event of each stays."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value", "props")
    path = f"{scratch_dir(spark)}/increment-{uuid.uuid4().hex}"
    half = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for source in (events.where(F.col("ts") <= half), events, events):
        I.load(source, path, ["user_id", "event_type"], "ts", buckets=16)
    return I.read_target(spark, path)


@query("SELECT event_id, user_id, event_type, ts FROM events")
def streamed_load(spark, sf_dir):
    """Events merged by their id from a stream, the ordering column inferred from the names."""
    path = f"{scratch_dir(spark)}/increment-{uuid.uuid4().hex}"
    stream = C.read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    I.load_stream(stream, f"{path}/table", f"{path}/offsets", "event_id", "ts", buckets=16)
    return I.read_target(spark, f"{path}/table")


#: Statements whose references need scopes, with an order's number as a literal; {r} is a region-like suffix.
SCOPED = (
    "SELECT e.id, e.total FROM (SELECT id, total FROM sales.{r}_orders WHERE prio = {k}) e JOIN (SELECT cust FROM crm.customers) AS d ON d.cust = e.id",
    "WITH c(x) AS (SELECT total FROM sales.{r}_orders), d AS (SELECT x FROM c) SELECT d.x, EXTRACT(YEAR FROM dt) FROM d, crm.customers k WHERE k.id = {k}",
    "MERGE INTO ledger.entries USING sales.{r}_orders o ON entries.id = o.id WHEN MATCHED THEN UPDATE SET total = o.total WHEN NOT MATCHED THEN INSERT (id, note) VALUES (o.id, 'n{k}')",
    "SELECT id FROM sales.{r}_orders WHERE note IS DISTINCT FROM 'x{k}' UNION ALL SELECT TRIM(BOTH ' ' FROM name) FROM crm.customers ORDER BY name",
    "SELECT o.id::int, (SELECT max(paid) FROM ledger.entries WHERE entries.id = o.id) FROM sales.{r}_orders o WHERE EXISTS (SELECT 1 FROM crm.customers c WHERE c.id = o.cust AND [My Col] > {k})",
)
#: (statement, table or None for the orders table, role, name, times) that they refer to.
SCOPED_COLUMNS = (
    (0, None, "select", "id", 2), (0, None, "select", "total", 2), (0, None, "where", "prio", 1), (0, "crm.customers", "select", "cust", 1), (0, "crm.customers", "join_on", "cust", 1), (0, None, "join_on", "id", 1),
    (1, None, "select", "total", 1), (1, None, "select", "x", 2), (1, None, "select", "dt", 1), (1, "crm.customers", "where", "id", 1),
    (2, "ledger.entries", "join_on", "id", 1), (2, None, "join_on", "id", 1), (2, "ledger.entries", "where", "total", 1), (2, None, "where", "total", 1), (2, "ledger.entries", "select", "id", 1), (2, "ledger.entries", "select", "note", 1),
    (3, None, "select", "id", 1), (3, None, "where", "note", 1), (3, "crm.customers", "select", "name", 1), (3, "crm.customers", "order_by", "name", 1),
    (4, None, "select", "id", 1), (4, "ledger.entries", "select", "paid", 1), (4, "ledger.entries", "where", "id", 1), (4, None, "where", "id", 1), (4, "crm.customers", "where", "id", 1), (4, None, "where", "cust", 1), (4, "crm.customers", "where", "my col", 1),
)
SCOPED_TABLES = ((0, None), (0, "crm.customers"), (1, None), (1, "crm.customers"), (2, "ledger.entries"), (2, None), (3, None), (3, "crm.customers"), (4, None), (4, "crm.customers"), (4, "ledger.entries"))
KINDS = "k AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS kind, concat('sales.', lower(o_orderstatus), '_orders') AS orders, count(*) AS n FROM orders GROUP BY ALL)"


def scoped_log(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{r}"), F.lower("o_orderstatus")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    text = F.element_at(F.array(*map(fill, SCOPED)), (F.col("o_orderkey") % len(SCOPED) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("stmt"), text.alias("sql"))


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


@query(f"""WITH {KINDS} SELECT coalesce(t, orders) AS table_key, role, name, CAST(sum(n * times) AS BIGINT) AS n
FROM k JOIN (VALUES {_values(SCOPED_COLUMNS)}) v(kind, t, role, name, times) USING (kind) GROUP BY ALL""")
def scoped_columns(spark, sf_dir):
    """Columns of derived tables, WITH queries, MERGE, UNION members and correlated subqueries, each in its scope."""
    return X.column_refs(scoped_log(spark, sf_dir)).groupBy("table_key", "role", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {KINDS} SELECT coalesce(t, orders) AS table_key, CAST(sum(n) AS BIGINT) AS n FROM k JOIN (VALUES {_values(SCOPED_TABLES)}) v(kind, t) USING (kind) GROUP BY ALL""")
def scoped_tables(spark, sf_dir):
    return X.table_refs(scoped_log(spark, sf_dir)).groupBy("table_key").agg(F.count("*").alias("n"))


@query("SELECT concat('sales.', lower(o_orderstatus), '_orders') AS orders, CAST(o_orderkey % 5 AS INTEGER) AS kind, count(*) AS statements, CAST(1 AS BIGINT) AS shapes FROM orders GROUP BY ALL")
def statement_shapes(spark, sf_dir):
    """Statements by shape: those that differ in literals alone have one."""
    log = scoped_log(spark, sf_dir).select((F.col("stmt") % 5).cast("int").alias("kind"), F.regexp_extract("sql", r"sales\.\w_orders", 0).alias("orders"), X.shape(F.col("sql")).alias("shape"))
    return log.groupBy("orders", "kind").agg(F.count("*").alias("statements"), F.count_distinct("shape").alias("shapes"))
