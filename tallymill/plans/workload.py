"""Workload queries: user-level SQL over the sales tables. Both engines run the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "outstanding_balance": """
WITH billed AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS net FROM lineitem GROUP BY l_orderkey),
late AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
active AS (SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))
SELECT o.o_orderkey, a.c_name, round(o.o_totalprice - coalesce(b.net, 0), 4) AS gap
FROM orders o JOIN active a ON a.c_custkey = o.o_custkey LEFT JOIN billed b ON b.l_orderkey = o.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.l_orderkey = o.o_orderkey) AND abs(o.o_totalprice - coalesce(b.net, 0)) > 1000""",
    "correlated_counts": """
SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45))
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority IN ('1-URGENT'))""",
    "running_totals": """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS nth, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS priority_rank FROM orders""",
    "rollup_having": """
SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus, o_orderpriority) HAVING count(*) > 3""",
    "cube_having": """
SELECT c_mktsegment, o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 4) AS mean
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus) HAVING count(*) > 10""",
    "join_chain": """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""",
    "line_aggregate_gap": """
WITH sums AS (SELECT l_orderkey, sum(l_extendedprice) AS gross FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, round(gross, 2) AS gross, o_totalprice FROM orders JOIN sums ON l_orderkey = o_orderkey WHERE abs(gross - o_totalprice) > 100""",
    "scalar_subquery_gap": """
SELECT o_orderkey, round(o_totalprice - coalesce((SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey), 0), 2) AS gap FROM orders
WHERE o_totalprice > coalesce((SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey), 0)""",
    "conditional_flags": """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 THEN 'rich' ELSE 'normal' END AS flag, try_cast(substr(c_name, 10) AS BIGINT) AS number
FROM customer WHERE c_mktsegment LIKE '%U%' AND c_name LIKE 'Customer%'""",
    "latest_per_key": """
WITH ranked AS (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) AS rn FROM lineitem)
SELECT r.l_orderkey, r.l_linenumber FROM ranked r WHERE rn = 1 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.l_orderkey AND o.o_orderstatus = 'F')""",
    "status_filter_join": """
SELECT o_orderkey, c_name, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""",
    "multi_cte_star": """
WITH o AS (SELECT * FROM orders WHERE o_totalprice > 1000), l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
c AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT n_nationkey, n_name FROM nation)
SELECT n_name, count(*) AS orders, round(sum(q), 2) AS quantity FROM o JOIN c ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN n ON n_nationkey = c_nationkey GROUP BY n_name""",
    "dense_rank_range_frame": """
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS r,
  round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_quantity), 2) AS running FROM lineitem""",
    "anti_and_semi": """
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A')
  AND EXISTS (SELECT 1 FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) s WHERE s.l_orderkey = o.o_orderkey AND s.q > 50)""",
    "full_outer_chain": """
SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, count(o.o_orderkey) AS orders, count(l.l_linenumber) AS lines
FROM customer c FULL OUTER JOIN orders o ON o.o_custkey = c.c_custkey FULL OUTER JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY coalesce(c.c_custkey, o.o_custkey)""",
    "single_scan_filter": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 5000 AND l_linestatus = 'O'",
    "theta_residue": """
SELECT c_custkey, o_orderkey, l_linenumber, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey WHERE o_orderdate <= l_shipdate""",
    "basic_aggregates": """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top
FROM orders WHERE o_totalprice BETWEEN 500 AND 400000 AND o_orderstatus IN ('O', 'F') AND o_orderdate IS NOT NULL GROUP BY o_orderpriority HAVING count(*) > 1""",
    "in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "monthly_revenue": """
SELECT date_trunc('month', o_orderdate) AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus NOT IN ('P') GROUP BY date_trunc('month', o_orderdate)""",
    "supplier_pairs": """
SELECT a.s_nationkey, a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    "latest_event_state": """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1""",
    "incremental_rows": """
SELECT e.event_id, e.user_id FROM events e WHERE e.ts > (SELECT coalesce(max(ts), TIMESTAMP '1900-01-01 00:00:00') FROM events WHERE event_type = 'purchase')""",
}


def view_query(sql: str):
    """A query callable that reads the tables as views. Filters and column lists reach the parquet scans."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql)

    return run
