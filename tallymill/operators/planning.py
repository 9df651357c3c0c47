"""Plans over an inventory: gaps, waves and their figures, catalog keys and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import symmetric

CONTEXT, LISTED = 280, 8


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct()


def ghosts(edges: DataFrame, manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """(item): ends of edges that neither the manifest nor the inventory lists."""
    return endpoints(edges).join(manifest.select("item"), "item", "left_anti").join(inventory.select("item"), "item", "left_anti")


def gap_tables(found: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """(item): discovered items and ends of edges that the manifest lacks."""
    return found.select("item").union(endpoints(edges)).distinct().join(manifest.select("item"), "item", "left_anti")


def breakage(inventory: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """(item, unlisted, n_missing, reason): for each item whether the manifest lacks it, and its unlisted neighbours, the first eight by name."""
    away = symmetric(edges).select(F.col("src").alias("item"), F.col("dst").alias("other")).distinct().join(manifest.select(F.col("item").alias("other")), "other", "left_anti")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("other"))
    few = away.withColumn("_n", rank).groupBy("item").agg(F.count("*").alias("n_missing"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= LISTED, F.struct("_n", "other")))), lambda s: s["other"].cast("string")), ", ").alias("_names"))
    rows = inventory.select("item").join(manifest.select("item").distinct().withColumn("_in", F.lit(True)), "item", "left").join(few, "item", "left").na.fill(0, ["n_missing"])
    own = F.col("_in").isNull()
    reason = F.concat_ws("; ", F.when(own, "not in the manifest"), F.when(F.col("n_missing") > 0, F.concat(F.lit("missing: "), "_names")))
    return rows.select("item", own.alias("unlisted"), "n_missing", reason.alias("reason"))


def with_gap_wave(planned: DataFrame, missing: DataFrame, per_wave: int, most: int) -> DataFrame:
    """planned (item, wave) and a last wave of the first missing items, if fewer than `most` waves are in use."""
    last = planned.agg(F.coalesce(F.max("wave"), F.lit(0)).alias("_last"))
    extra = missing.select("item").orderBy("item").limit(per_wave).crossJoin(last).where(F.col("_last") < most)
    return planned.select("item", "wave", F.lit(False).alias("gap")).unionByName(extra.select("item", (F.col("_last") + 1).alias("wave"), F.lit(True).alias("gap")))


def wave_metrics(planned: DataFrame, inventory: DataFrame, hot: DataFrame, mapped: DataFrame, broken: DataFrame, digits: int = 2) -> DataFrame:
    """A row for each wave: tables, queries, mean, least and greatest priority, hotspots, tables with mappings, broken tables.

    planned (item, wave), inventory (item, query_count, priority); the other three are lists of item.
    """
    rows = planned.select("item", "wave").join(inventory.select("item", "query_count", "priority"), "item", "left")
    for name, side in (("hot", hot), ("mapped", mapped), ("broken", broken)):
        rows = rows.join(side.select("item").distinct().withColumn(name, F.lit(True)), "item", "left")
    return rows.groupBy("wave").agg(
        F.count("*").alias("tables"), F.coalesce(F.sum("query_count"), F.lit(0)).alias("queries"), F.round(F.avg("priority"), digits).alias("avg_priority"), F.round(F.min("priority"), 2).alias("min_priority"),
        F.round(F.max("priority"), 2).alias("max_priority"), *(F.count_if(F.col(c).isNotNull()).alias(c) for c in ("hot", "mapped", "broken")),
    )


def wave_status(rows: DataFrame, wave: str, status: Column, bypass: int | None = None) -> DataFrame:
    """(wave, n, status, ready, blocked): HITL_REQUIRED if any row needs it, SUCCESS if all succeeded, else PENDING.

    A wave is ready if all its rows are SUCCESS or PARTIAL; one that isn't blocks all later ones, but for the bypassed
    one. Only one row a wave enters the ordered window.
    """
    s = F.coalesce(status, F.lit("PENDING"))
    state = F.when(F.bool_or(s == "HITL_REQUIRED"), "HITL_REQUIRED").when(F.bool_and(s == "SUCCESS"), "SUCCESS").otherwise("PENDING")
    per = rows.groupBy(F.col(wave).alias("wave")).agg(F.count("*").alias("n"), state.alias("status"), F.bool_and(s.isin("SUCCESS", "PARTIAL")).alias("ready"))
    stops = ~F.col("ready") if bypass is None else ~F.col("ready") & (F.col("wave") != bypass)
    before = F.bool_or(stops).over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("blocked", F.coalesce(before, F.lit(False)))


def queues_by_wave(planned: DataFrame, scored: DataFrame) -> DataFrame:
    """(wave, green, yellow, red, unknown): scored is (item, queue)."""
    rows = planned.select("item", "wave").join(scored.select("item", "queue"), "item", "left")
    known = ("green", "yellow", "red")
    return rows.groupBy("wave").agg(*(F.count_if(F.col("queue") == q).alias(q) for q in known), F.count_if(~F.coalesce(F.col("queue").isin(*known), F.lit(False))).alias("unknown"))


def shorten(c: Column, most: int = CONTEXT) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def enrich(planned: DataFrame, facts: DataFrame, inventory: DataFrame, mapped: DataFrame) -> DataFrame:
    """planned rows with context and note: facts (item, text) before inventory's description; mapped (item, n)."""
    rows = planned.join(facts.select("item", F.trim("text").alias("_f")), "item", "left").join(inventory.select("item", F.trim("description").alias("_d"), "status"), "item", "left").join(mapped.select("item", "n"), "item", "left")
    context = shorten(F.when(F.coalesce("_f", F.lit("")) != "", F.col("_f")).otherwise(F.coalesce("_d", F.lit(""))))
    note = F.concat_ws(" - ", F.when(F.trim("status") != "", F.trim("status")), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" merge cluster(s)"))))
    return rows.select(*planned.columns, context.alias("context"), note.alias("note"))


def fact_sheets(inventory: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(item, query_count, text) of the busiest items that have a text, ties by item."""
    return inventory.select("item", "query_count").join(texts.where(F.trim("text") != ""), "item").orderBy(F.col("query_count").desc(), "item").limit(most)


def domain_order(rows: DataFrame) -> DataFrame:
    """(domain, position, tables, top_priority): domains by their most urgent row; rows is (item, domain, priority).

    The most urgent row is a minimum over (falling priority, name), so rows are never sorted as a whole.
    """
    per = rows.groupBy(F.coalesce("domain", F.lit("Unclassified")).alias("domain")).agg(F.min(F.struct((-F.col("priority")).alias("p"), "item")).alias("_f"), F.count("*").alias("tables"))
    return per.select("domain", F.row_number().over(Window.orderBy("_f")).alias("position"), "tables", (-F.col("_f.p")).alias("top_priority"))


def foreign_keys(columns: DataFrame, declared: DataFrame) -> DataFrame:
    """(child, parent, col): declared keys, else a column *_id, not a key of its own table, that is the primary key of another.

    columns is (pos, table_key, col, is_key): the parent that comes first wins; a table with declared keys infers none.
    """
    told = declared.select("child", "parent", "col").where("child <> parent").distinct()
    keys = columns.where("is_key").groupBy(F.lower("col").alias("_k"), F.col("table_key").alias("parent")).agg(F.min("pos").alias("pos"))
    open_ = columns.where(~F.col("is_key") & F.lower("col").endswith("_id")).select(F.col("table_key").alias("child"), "col", F.lower("col").alias("_k")).distinct()
    open_ = open_.join(told.select("child").distinct(), "child", "left_anti")
    first = open_.join(keys, "_k").where("child <> parent").groupBy("child", "col").agg(F.min(F.struct("pos", "parent")).alias("p"))
    return told.unionByName(first.select("child", F.col("p.parent").alias("parent"), "col"))


def key_flags(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """columns (table_key, col, ...) with is_key 0 or 1; keys is (table_key, col)."""
    return columns.join(keys.select("table_key", "col").distinct().withColumn("is_key", F.lit(1)), ["table_key", "col"], "left").na.fill(0, ["is_key"])


def type_conflicts(columns: DataFrame) -> DataFrame:
    """(domain, col, types, tables): names with more than one type in a domain; minima and maxima, no self-join."""
    per = columns.groupBy("domain", F.lower("col").alias("col")).agg(F.min(F.upper("type")).alias("lo"), F.max(F.upper("type")).alias("hi"), F.count_distinct(F.upper("type")).alias("types"), F.count_distinct("table_key").alias("tables"))
    return per.where("types > 1").select("domain", "col", F.concat("lo", F.lit(" / "), "hi").alias("example"), "types", "tables")


def run_rows(results: DataFrame) -> DataFrame:
    """(model, n): rows affected, the first present of three fields, null if it is no whole number. results is (model, response), response JSON."""
    whole = F.get_json_object("response", "$.rows_affected"), F.get_json_object("response", "$.rows"), F.get_json_object("response", "$.records_affected")
    return results.where("model <> ''").select("model", F.coalesce(*whole).try_cast("long").alias("n"))


def token_rollup(rows: DataFrame, in_rate: float, out_rate: float) -> DataFrame:
    """(agent, tokens, cost, calls, share): rows is (agent, tokens); half of the tokens are priced as input, half as output, per thousand."""
    per = rows.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("calls"))
    total = per.agg(F.sum("tokens").alias("_t"))
    return per.crossJoin(total).select("agent", "tokens", F.round(F.col("tokens") / 2000.0 * (in_rate + out_rate), 6).alias("cost"), "calls", F.round(F.when(F.col("_t") > 0, F.col("tokens") / F.col("_t")).otherwise(0.0), 6).alias("share"))


def schema_breakdown(inventory: DataFrame) -> DataFrame:
    """(schema, tables, queries, pct_ready): inventory is (item, schema, query_count, status)."""
    ready = F.round(100.0 * F.count_if(F.col("status") == "Ready") / F.count("*"), 2)
    return inventory.groupBy("schema").agg(F.count("*").alias("tables"), F.sum("query_count").alias("queries"), ready.alias("pct_ready"))


def overlap(found: DataFrame, manifest: DataFrame, least_rows: int = 10, least_share: float = 0.05) -> DataFrame:
    """(n, listed, share, enforce): whether found items match a manifest well enough for its absence to mean anything."""
    rows = found.select("item").distinct().join(manifest.select("item").distinct().withColumn("_in", F.lit(1)), "item", "left")
    out = rows.agg(F.count("*").alias("n"), F.count("_in").alias("listed"))
    share = F.when(F.col("n") > 0, F.col("listed") / F.col("n")).otherwise(0.0)
    return out.select("n", "listed", F.round(share, 6).alias("share"), ((F.col("n") < least_rows) | (share >= least_share)).alias("enforce"))


def rules_hash(rules: DataFrame, by: str) -> DataFrame:
    """(key, n, digest): SHA-256 of a key's sorted distinct rules, one a line. Rules of a contract are few by nature."""
    listed = F.sort_array(F.collect_set("rule"))
    return rules.groupBy(F.col(by).alias("key")).agg(F.count_distinct("rule").alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))
