"""Report filters, review queues, renames, catalog resolution, summaries and orders of planning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mention_score
from .scoring import positions


def mappings_in_scope(mappings: DataFrame, inventory: DataFrame, least: float, domains: list, portfolio: str | None = None) -> DataFrame:
    """Rows of mappings (table, confidence, ...) of at least that confidence whose table's inventory row (table, domain, portfolio) is in the domains; an unknown portfolio passes."""
    facts = inventory.select("table", "domain", "portfolio")
    rows = mappings.where(F.col("confidence") >= least).join(facts, "table", "left").where(F.col("domain").isin(domains))
    if portfolio is not None:
        rows = rows.where(F.col("portfolio").isNull() | (F.col("portfolio") == portfolio))
    return rows.select(*mappings.columns)


def cards_in_scope(cards: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of cards (card, tables ARRAY) of which any table is allowed (table); card numbers the rows."""
    hits = cards.select("card", F.explode("tables").alias("table")).join(allowed.select("table").distinct(), "table", "left_semi")
    return cards.join(hits.select("card").distinct(), "card", "left_semi")


def in_domains(rows: DataFrame, domains: list[str] | None, column: str = "domain") -> DataFrame:
    """Matrix rows of the domains; none stated keeps all."""
    return rows.where(F.coalesce(F.col(column), F.lit("")).isin(domains)) if domains else rows


def in_tables(rows: DataFrame, allowed: DataFrame | None, column: str = "table_key") -> DataFrame:
    """Hotspots or search hits whose table is allowed (table); None keeps all, an empty table none."""
    if allowed is None:
        return rows
    return rows.join(allowed.select(F.col("table").alias("_allowed")).distinct(), F.col(column) == F.col("_allowed"), "left_semi")


def cards_by_scope(cards: DataFrame, inventory: DataFrame, least: float, domains: list[str] | None = None, portfolio: str | None = None) -> DataFrame:
    """Rows of cards (card, kind, domain, tables ARRAY, confidence) of at least that confidence, of which any table is in the domains and the portfolio.

    inventory is (table, domain, portfolio). Cards of the glossary's source pass whatever their tables; a card without
    tables goes by its own domain; a table of an unknown portfolio passes. card numbers the rows.
    """
    rows = cards.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    named = F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    each = rows.select("card", F.explode(F.transform(named, lambda t: F.trim(t))).alias("table")).join(inventory.select("table", "domain", "portfolio"), "table", "left")
    fits = F.col("domain").isin(domains) if domains else F.lit(True)
    if portfolio is not None:
        fits = fits & (F.coalesce("portfolio", F.lit("")).isin("", portfolio))
    passed = each.where(fits).select("card").distinct().withColumn("_in", F.lit(True))
    own = F.col("domain").isin(domains) if domains else F.lit(True)
    keep = (F.lower("kind") == "glossary_source") | F.col("_in") | ((F.size(named) == 0) & own)
    return rows.join(passed, "card", "left").where(F.coalesce(keep, F.lit(False))).select(*cards.columns)


def review_queue(rows: DataFrame, chosen: DataFrame, key: str, least: float = 0.0, most: float = 1.0, status: str = "pending", batch: int | None = None) -> DataFrame:
    """rows (confidence, ...) with status, the action chosen for their key or pending: those of one status and range of confidence, the surest first in a batch."""
    of = chosen.groupBy(key).agg(F.max("action").alias("status"))
    out = rows.join(of, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    out = out.where((F.col("status") == status) & F.col("confidence").between(least, most))
    return out if batch is None else out.orderBy(F.col("confidence").desc(), key).limit(batch)


def renamed(rows: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """The columns of a mapping (source, canonical) alone, under their canonical names; all of them as they are without a mapping."""
    return rows.select(*(F.col(f"`{source}`").alias(name) for source, name in names)) if names else rows


def importance_report(rows: DataFrame) -> DataFrame:
    """(table, column, score, logged_as): logged_as lists the names a column is logged under, null where that is its own name alone."""
    own = (F.size("sources") == 1) & (F.lower(F.element_at("sources", 1)) == F.lower("column"))
    return rows.select("table", "column", F.round("score", 4).alias("score"), F.when(~own, F.array_join(F.sort_array("sources"), ", ")).alias("logged_as"))


def resolve_catalog(tables: DataFrame, manifest: DataFrame, default: str) -> DataFrame:
    """(table, path): the manifest's path (table_key, path) of a table's key, else of the same key in other case, else the default."""
    exact = manifest.groupBy(F.col("table_key").alias("table")).agg(F.min("path").alias("_exact"))
    loose = manifest.groupBy(F.lower("table_key").alias("_low")).agg(F.min("path").alias("_loose"))
    rows = tables.select("table").join(exact, "table", "left").withColumn("_low", F.lower("table")).join(loose, "_low", "left")
    return rows.select("table", F.coalesce("_exact", "_loose", F.lit(default)).alias("path"))


def best_in_scope(counts: DataFrame, scope: str) -> DataFrame:
    """(scope, matches, statements, best): of a scope's tables (item, query_count), how many there are, their statements, and the busiest; ties go to the last key."""
    best = F.max(F.struct("query_count", "item"))["item"].alias("best")
    return counts.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("matches"), F.sum("query_count").alias("statements"), best)


def mentions(texts: DataFrame, tables: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(table, score, chunks): for each of a stated list of (schema, table), the sum of its mention scores over all texts and the texts with any; one pass."""
    sums = []
    for i, (schema, table) in enumerate(tables):
        score = mention_score(F.col(text), schema, table)
        sums += [F.coalesce(F.sum(score), F.lit(0)).alias(f"score{i}"), F.count_if(score > 0).alias(f"chunks{i}")]
    each = (F.struct(F.lit(f"{s}.{t}").alias("table"), F.col(f"score{i}").alias("score"), F.col(f"chunks{i}").alias("chunks")) for i, (s, t) in enumerate(tables))
    return texts.agg(*sums).select(F.inline(F.array(*each)))


def summary(inventory: DataFrame, edges: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of counts: tables, domains (sorted, joined), edges, pending and rejected review rows (status)."""
    a = inventory.agg(F.count("*").alias("tables"), F.array_join(F.sort_array(F.collect_set(F.col("domain").cast("string"))), ",").alias("domains"))
    b = edges.agg(F.count("*").alias("edges"))
    c = queue.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "reject").alias("rejected"))
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


def portfolio_order(inventory: DataFrame) -> DataFrame:
    """inventory (portfolio, domain, priority, table) with its position: core before debt, then domain, greatest priority, table."""
    return positions(inventory, [F.when(F.col("portfolio") == "core", 0).otherwise(1), F.col("domain"), F.col("priority").desc(), F.col("table")])


def dependency_order(inventory: DataFrame, edges: DataFrame) -> DataFrame:
    """inventory (table, priority) with position and lineage_used: an order in which every edge goes forward.

    An edge (a, b) leads from its table of greater priority (ties: the lesser name) to the other. Taking of the tables
    that no edge left holds back always the one of greatest priority is then the order by priority and name itself, as
    no table is ever held back by one behind it. lineage_used says whether an edge has both ends in the inventory.
    """
    names = inventory.select("table")
    inside = edges.join(names.withColumnRenamed("table", "a"), "a", "left_semi").join(names.withColumnRenamed("table", "b"), "b", "left_semi")
    used = not inside.where("a <> b").isEmpty()
    return positions(inventory, [F.col("priority").desc(), F.col("table")]).withColumn("lineage_used", F.lit(used))


def read_usage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(model, column, n) of CSV files with model_name, column_name and usage_count: counts that are no numbers are 0, blank names go, keys are summed."""
    rows = spark.read.option("header", True).csv(paths)
    model, column = F.trim("model_name"), F.trim("column_name")
    count = F.coalesce(F.expr("try_cast(trim(usage_count) AS bigint)"), F.lit(0))
    rows = rows.select(model.alias("model"), column.alias("column"), count.alias("n")).where("model <> '' and column <> ''")
    return rows.groupBy("model", "column").agg(F.sum("n").alias("n"))


Frame = Callable[[DataFrame], DataFrame]


def with_hooks(rows: DataFrame, extractor: Frame, scorer: Callable[[DataFrame], Column], sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """What an extractor makes of rows, with the scorer's column as score, given to the sink; all three are the user's own functions on DataFrames."""
    found = extractor(rows)
    out = found.withColumn("score", scorer(found))
    if sink:
        sink(out)
    return out


def run_with_hooks(spark: SparkSession, source: Callable[[SparkSession], DataFrame], extractor: Frame, scorer: Callable[[DataFrame], Column], sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """with_hooks() on what the user's own source reads."""
    return with_hooks(source(spark), extractor, scorer, sink)
