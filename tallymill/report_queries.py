"""Queries of report filters, summaries, orders, readers and stream figures, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as T
from .operators import extract as X
from .operators import reports as R
from .plans.scratch import scratch_dir
from .register import query, read
from .registry import COUNTS, EDGES, order_suppliers, statement_log, statement_table_counts, supplier_edges
from .sources import catalogs, logs
from .streaming import counts as C

INVENTORY = """i AS (SELECT s_suppkey AS "table", s_nationkey AS domain, abs(s_acctbal) / 100 AS priority,
  CASE WHEN s_acctbal >= 5000 THEN 'core' WHEN s_acctbal >= 0 THEN 'debt' END AS portfolio FROM supplier)"""


def inventory(spark, sf_dir):
    portfolio = F.when(F.col("s_acctbal") >= 5000, "core").when(F.col("s_acctbal") >= 0, "debt")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("table"), F.col("s_nationkey").alias("domain"), (F.abs("s_acctbal") / 100).alias("priority"), portfolio.alias("portfolio")
    )


def review_rows(spark, sf_dir):
    """(documents with a confidence, the actions chosen for them)"""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 20000.0).alias("confidence"))
    chosen = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "reject").alias("action"))
    return rows, chosen


QUEUE = """q AS (SELECT d.doc_id, d.n_chars / 20000.0 AS confidence, coalesce(CASE l.quality WHEN 1 THEN 'approve' WHEN 0 THEN 'reject' END, 'pending') AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query(f"""WITH {INVENTORY} SELECT l_orderkey, l_linenumber, l_suppkey AS "table", l_discount * 10 AS confidence FROM lineitem JOIN i ON i."table" = l_suppkey
WHERE l_discount * 10 >= 0.5 AND domain IN (1, 2, 3, 5, 8, 13, 21) AND coalesce(portfolio, 'core') = 'core'""")
def mappings_in_scope(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("table"), (F.col("l_discount") * 10).alias("confidence"))
    return R.mappings_in_scope(rows, inventory(spark, sf_dir), 0.5, [1, 2, 3, 5, 8, 13, 21], "core")


@query("""SELECT l_orderkey AS card, count(DISTINCT l_suppkey) AS tables FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 8000) GROUP BY l_orderkey""")
def cards_in_scope(spark, sf_dir):
    cards = order_suppliers(spark, sf_dir).groupBy(F.col("stmt").alias("card")).agg(F.collect_set("item").alias("tables"))
    allowed = read(spark, sf_dir, "supplier").where("s_acctbal >= 8000").select(F.col("s_suppkey").alias("table"))
    return R.cards_in_scope(cards, allowed).select("card", F.size("tables").cast("long").alias("tables"))


@query(f"WITH {QUEUE} SELECT * FROM q WHERE status = 'pending' AND confidence BETWEEN 0.05 AND 0.5")
def review_queue(spark, sf_dir):
    return R.review_queue(*review_rows(spark, sf_dir), "doc_id", 0.05, 0.5)


RENAMES = [("o_orderkey", "order_id"), ("o_custkey", "customer_id"), ("o_totalprice", "amount"), ("o_orderstatus", "status")]


@query("""SELECT c_name AS customer_name, o_orderkey AS order_id, o_totalprice AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""")
def renamed_view_join(spark, sf_dir):
    """A view of renamed columns joined to a base table."""
    R.renamed(read(spark, sf_dir, "orders"), RENAMES).createOrReplaceTempView("renamed_orders")
    read(spark, sf_dir, "customer").createOrReplaceTempView("base_customer")
    return spark.sql("SELECT c_name AS customer_name, order_id, amount FROM renamed_orders JOIN base_customer ON c_custkey = customer_id WHERE status = 'F'")


@query("""SELECT source AS "table", lower(lang) AS "column", round(max(n_chars) / 1000, 4) AS score, CASE WHEN count(DISTINCT lang) = 1 AND min(lang) = lower(min(lang)) THEN NULL ELSE string_agg(DISTINCT lang, ', ' ORDER BY lang) END AS logged_as
FROM (SELECT source, lang, n_chars FROM documents UNION ALL SELECT source, upper(lang), n_chars FROM documents WHERE n_chars > 5000) d GROUP BY source, lower(lang)""")
def importance_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    rows = docs.union(docs.where("n_chars > 5000").select("source", F.upper("lang"), "n_chars")).groupBy(F.col("source").alias("table"), F.lower("lang").alias("column"))
    return R.importance_report(rows.agg((F.max("n_chars") / 1000).alias("score"), F.collect_set("lang").alias("sources")))


@query("""SELECT s_name AS "table", CASE WHEN s_acctbal > 0 THEN concat('ddl/', s_suppkey, '.json') ELSE 'ddl/default.json' END AS path FROM supplier""")
def resolved_catalogs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    key = F.when(F.col("s_nationkey") < 10, F.upper("s_name")).otherwise(F.col("s_name"))
    manifest = s.where("s_acctbal > 0").select(key.alias("table_key"), F.concat(F.lit("ddl/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"))
    return R.resolve_catalog(s.select(F.col("s_name").alias("table")), manifest, "ddl/default.json")


@query(f"""WITH {COUNTS}, k AS (SELECT s_nationkey AS scope, item, query_count FROM c JOIN supplier ON s_suppkey = item),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY query_count DESC, item DESC) AS n FROM k)
SELECT scope, count(*) AS matches, CAST(sum(query_count) AS BIGINT) AS statements, max(CASE WHEN n = 1 THEN item END) AS best FROM r GROUP BY scope""")
def scoped_counts(spark, sf_dir):
    scopes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), "s_nationkey")
    return R.best_in_scope(statement_table_counts(spark, sf_dir).join(scopes, "item"), "s_nationkey")


def _mentions_sql(schema: str, table: str) -> str:
    times = lambda k: f"((length(low) - length(replace(low, '{k}', ''))) // {len(k)})"
    score = f"(3 * {times(f'{schema}.{table}')} + 2 * {times(table)} + CASE WHEN regexp_matches(low, '(^|[^_\\p{{L}}\\p{{N}}]){table}($|[^_\\p{{L}}\\p{{N}}])') THEN 1 ELSE 0 END)"
    return f"""SELECT '{schema}.{table}' AS "table", CAST(sum({score}) AS BIGINT) AS score, count(CASE WHEN {score} > 0 THEN 1 END) AS chunks FROM d"""


MENTIONED = [("of", "the"), ("in", "der"), ("de", "la"), ("no", "such")]


@query("WITH d AS (SELECT lower(coalesce(text, '')) AS low FROM documents) " + " UNION ALL ".join(_mentions_sql(*x) for x in MENTIONED))
def table_mentions(spark, sf_dir):
    return R.mentions(read(spark, sf_dir, "documents"), MENTIONED)


@query(f"""WITH {INVENTORY}, {EDGES}, {QUEUE} SELECT (SELECT count(*) FROM i) AS tables,
(SELECT string_agg(DISTINCT CAST(domain AS VARCHAR), ',' ORDER BY CAST(domain AS VARCHAR)) FROM i) AS domains, (SELECT count(*) FROM e) AS edges,
(SELECT count(*) FROM q WHERE status = 'pending') AS pending, (SELECT count(*) FROM q WHERE status = 'reject') AS rejected""")
def report_summary(spark, sf_dir):
    rows, chosen = review_rows(spark, sf_dir)
    queue = rows.join(chosen, "doc_id", "left").select(F.coalesce("action", F.lit("pending")).alias("status"))
    return R.summary(inventory(spark, sf_dir), supplier_edges(spark, sf_dir), queue)


@query(f"""WITH {INVENTORY} SELECT "table", row_number() OVER (ORDER BY CASE WHEN portfolio = 'core' THEN 0 ELSE 1 END, domain, priority DESC, "table") AS position FROM i""")
def portfolio_order(spark, sf_dir):
    return R.portfolio_order(inventory(spark, sf_dir)).select("table", "position")


@query(f"""WITH {INVENTORY}, {EDGES} SELECT "table", row_number() OVER (ORDER BY priority DESC, "table") AS position, (SELECT count(*) FROM e) > 0 AS lineage_used FROM i""")
def dependency_order(spark, sf_dir):
    return R.dependency_order(inventory(spark, sf_dir), supplier_edges(spark, sf_dir)).select("table", "position", "lineage_used")


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT event_type AS model, CAST(user_id AS VARCHAR) AS "column", CAST(sum(CASE WHEN value >= 0 THEN floor(value) ELSE 0 END) AS BIGINT) AS n FROM events WHERE trim(event_type) <> '' GROUP BY 1, 2""")
def usage_csv(spark, sf_dir):
    path = _folder(spark, "usage")
    count = F.when(F.col("value") >= 0, F.floor("value").cast("string")).otherwise("none")
    read(spark, sf_dir, "events").select(F.col("event_type").alias("model_name"), F.col("user_id").alias("column_name"), count.alias("usage_count")).write.option("header", True).csv(path)
    return R.read_usage(spark, path)


@query("SELECT c_custkey, trim(regexp_replace(concat(c_name, ' [HE] ', c_mktsegment), '\\s+', ' ', 'g')) AS masked FROM customer")
def rtl_masking(spark, sf_dir):
    text = F.concat("c_name", F.lit(" שלום  עולם "), "c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", T.mask_rtl(text).alias("masked"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'tsql' WHEN 'de' THEN 'postgres' ELSE lang END AS dialect, count(*) AS n FROM documents GROUP BY 1, 2")
def dialect_names(spark, sf_dir):
    name = F.when(F.col("lang") == "en", " SQL_Server").when(F.col("lang") == "de", "PG").otherwise(F.upper("lang"))
    return read(spark, sf_dir, "documents").groupBy("lang", T.dialect(name).alias("dialect")).agg(F.count("*").alias("n"))


def insert_log(spark, sf_dir):
    """A log of INSERT statements with bare names, quoted names and three-part names."""
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("INSERT INTO ledger.entries (order_id, \"Amount\") SELECT id, sum(total) AS t FROM db . sales.f$"), F.lower("o_orderstatus"), F.lit(" WHERE prio IN (1, 2) AND f$"), F.lower("o_orderstatus"), F.lit(".st = 'x, y' GROUP BY id ORDER BY t"))
    return o.select(F.col("o_orderkey").alias("stmt"), text.alias("sql"))


@query("""WITH k AS (SELECT concat('sales.f$', lower(o_orderstatus)) AS o, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM k)
SELECT o AS table_key, role, name, n FROM k, (VALUES ('select', 'id'), ('select', 'total'), ('where', 'prio'), ('where', 'st'), ('group_by', 'id')) v(role, name)
UNION ALL SELECT 'ledger.entries', 'select', name, n FROM t, (VALUES ('order_id'), ('amount')) v(name)""")
def extracted_bare_columns(spark, sf_dir):
    return X.column_refs(insert_log(spark, sf_dir)).groupBy("table_key", "role", "name").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'empty' WHEN o_orderpriority = '5-LOW' THEN 'skipped_empty' ELSE 'regex' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def parse_outcomes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stmt"), "o_orderpriority")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "COMMIT").when(F.col("o_orderpriority") == "5-LOW", "-- select a from b")
    log = o.select("stmt", text.alias("sql"))
    return X.outcome(log.where("sql is not null").union(statement_log(spark, sf_dir).join(o.where(text.isNull()), "stmt", "left_semi"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS name, concat('SELECT ', s_name, chr(10), 'FROM t') AS text FROM supplier")
def sql_files(spark, sf_dir):
    """A file for each supplier, written and read whole."""
    path = _folder(spark, "sql")
    s = read(spark, sf_dir, "supplier")
    text = F.concat(F.lit("SELECT "), F.coalesce("s_name", F.lit("")), F.lit("\nFROM t"))
    logs.write_sql_files(s.select(F.col("s_suppkey").cast("string").alias("name"), text.alias("text")), path)
    name = F.regexp_extract("path", r"/name=([^/]*)\.sql$", 1)
    return logs.read_sql_files(spark, path).select(F.when(name != "", name).alias("name"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("SELECT o_orderkey AS id, concat(o_orderpriority, ' | \"', o_orderstatus, '\"') AS note FROM orders")
def ticket_csv(spark, sf_dir):
    """Tickets of two lines with quotes, written as CSV and read back."""
    path = _folder(spark, "tickets")
    note = F.concat("o_orderpriority", F.lit(" \n\n \""), "o_orderstatus", F.lit('"'))
    logs.write_tickets(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), note.alias("note")), path)
    return spark.read.option("header", True).option("escape", "\\").csv(path).select(F.col("id").cast("long").alias("id"), "note")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS payloads, 'invalid JSON' AS reason, 'ingest' AS stage FROM events WHERE value < 0 OR event_type = 'click'")
def dead_letters(spark, sf_dir):
    bad = (F.col("value") < 0) | (F.col("event_type") == "click")
    line = F.when(bad, F.concat(F.lit("{bad "), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("props").alias("sql"))))
    letters = logs.dead_letters(logs.parse_log(read(spark, sf_dir, "events").select(line.alias("value"))), "ingest", "run-1")
    return letters.groupBy(F.col("error_reason").alias("reason"), F.col("error_stage").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("original_payload").alias("payloads"))


@query("SELECT role AS channel, count(*) AS n, count(DISTINCT text) AS texts FROM conversations WHERE text <> '' GROUP BY role")
def flat_messages(spark, sf_dir):
    path = _folder(spark, "messages")
    read(spark, sf_dir, "conversations").select(F.to_json(F.struct(F.col("role").alias("channel"), "text", F.col("turn").cast("string").alias("ts"))).alias("value")).write.text(path)
    return logs.read_messages(spark, path, "*.txt").groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click' ORDER BY ts DESC, event_id LIMIT 50")
def latest_log_entries(spark, sf_dir):
    """The newest rows of an append log; lines that are no JSON go."""
    path = _folder(spark, "entries")
    good = F.to_json(F.struct(F.format_string("%012d", "event_id").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp")))
    read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "{broken").otherwise(good).alias("value")).write.text(path)
    return catalogs.latest_entries(spark, path, "event_id string, event_type string").select(F.col("event_id").cast("long").alias("event_id"), "event_type")


@query(r"""SELECT doc_id, md5(nfc_normalize(regexp_replace(concat('e', chr(769), chr(133), chr(7), text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]', '', 'g'))) AS digest
FROM documents""")
def clean_texts(spark, sf_dir):
    """Whole texts behind a decomposed letter and two control characters, cleaned and composed."""
    text = F.concat(F.lit("e\u0301\u0085\u0007"), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize(text)).alias("digest"))


@query("""SELECT p_partkey, lower(concat(p_brand, '.', p_type)) AS key, '[Db]' AS db, p_brand AS "schema", p_type AS "table", concat('a ', p_brand) AS plain, (p_brand = p_type) AS same FROM part""")
def name_parts(spark, sf_dir):
    name = F.concat(F.lit("[Db]."), F.col("p_brand"), F.lit("."), F.col("p_type"))
    parts = T.split_name(name)
    plain = T.sanitize(T.strip_blocks(F.concat(F.lit("{{ ref('x') }} a\u0007 "), F.col("p_brand"), F.lit(" {{ y\n}}"))))
    return read(spark, sf_dir, "part").select("p_partkey", T.manifest_key(name).alias("key"), parts["db"].alias("db"), parts["schema"].alias("schema"), parts["table"].alias("table"), plain.alias("plain"), (F.col("p_brand") == F.col("p_type")).alias("same"))


@query(f"WITH {EDGES} SELECT a, b, weight FROM e")
def stream_pairs(spark, sf_dir):
    """Pair weights kept up to date over a stream of statements, each with its tables."""
    path = _folder(spark, "statements")
    order_suppliers(spark, sf_dir).groupBy("stmt").agg(F.collect_set("item").alias("items")).write.parquet(path)
    return C.drain_sums(C.read_files(spark, path), C.pairs, ["a", "b"]).select("a", "b", F.least("weight", F.lit(10000)).alias("weight"))


@query("SELECT count(*) AS rows, true AS timed FROM events")
def stream_progress(spark, sf_dir):
    """Rows that a stream took in, by its own progress reports."""
    kept = C.drain(C.counts(C.read_table(spark, sf_dir, "events"), "event_type", "value"), ["item"], progress := [])
    assert kept.columns
    return C.progress(spark, progress).agg(F.sum("rows").alias("rows"), (F.max("rows_per_second") > 0).alias("timed"))


@query("SELECT o_orderkey, upper(o_orderstatus) AS found, o_totalprice / 1000 AS score FROM orders WHERE o_orderstatus <> 'P'")
def hooked_extraction(spark, sf_dir):
    """A user's own source, extractor, scorer and sink round a run."""
    path = _folder(spark, "sink")
    own = lambda df: df.where("o_orderstatus <> 'P'").select("o_orderkey", F.upper("o_orderstatus").alias("found"), "o_totalprice")
    R.with_hooks(read(spark, sf_dir, "orders"), own, lambda df: df["o_totalprice"] / 1000, lambda df: df.drop("o_totalprice").write.parquet(path))
    return spark.read.parquet(path)
