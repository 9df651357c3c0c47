"""Scores, queues and plans over an inventory of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_name
from ..plans.scratch import free_name, materialize


def ladder(value: Column, steps: list[tuple[float, object]], otherwise) -> Column:
    """The first step's result whose bound the value reaches, bounds falling; null values get the last."""
    out = F
    for bound, result in steps:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def inventory(counts: DataFrame, columns: DataFrame, merged: DataFrame) -> DataFrame:
    """(item, query_count, column_count, priority, status): priority is a share of the busiest item's count, in percent.

    counts (item, query_count), columns (item, column_count), merged (item, confirmed).
    """
    top = counts.agg(F.max("query_count").alias("top"))
    rows = counts.join(columns, "item", "left").join(merged, "item", "left").na.fill(0, ["column_count", "confirmed"]).crossJoin(F.broadcast(top))
    status = F.when(F.col("column_count") == 0, "Empty").when(F.col("confirmed") == 0, "Discovered").when(F.col("confirmed") < F.col("column_count"), "Needs Review").otherwise("Ready")
    return rows.select("item", "query_count", "column_count", F.round(100.0 * F.col("query_count") / F.col("top"), 2).alias("priority"), status.alias("status"))


def scoped_inventory(counts: DataFrame, columns: DataFrame, in_scope: DataFrame, default_database: str = "") -> DataFrame:
    """(database, schema, table, item, query_count, column_count, priority, status) of dotted items when several tables are merged.

    counts (item, query_count), columns (item, column_count), in_scope (item, merged): items of the scope are Merged, or
    Needs Review where merged isn't true; others are Discovered, or Ephemeral if their schema holds TEMP or JUNK, or
    their name TEMP. Names without a dot are no tables. priority is a share of the busiest item's count, in percent.
    """
    top = counts.agg(F.max("query_count").alias("top"))
    rows = counts.where(F.contains("item", F.lit("."))).join(columns, "item", "left").join(in_scope.groupBy("item").agg(F.bool_or("merged").alias("merged"), F.lit(True).alias("scoped")), "item", "left")
    name = split_name(F.col("item"))
    rows = rows.crossJoin(F.broadcast(top)).withColumn("_n", name)
    schema = F.coalesce("_n.schema", F.lit(""))
    passing = F.upper(schema).contains("JUNK") | F.upper("item").contains("TEMP")
    status = F.when(F.col("scoped"), F.when(F.col("merged"), "Merged").otherwise("Needs Review")).when(passing, "Ephemeral").otherwise("Discovered")
    return rows.select(
        F.coalesce("_n.db", F.lit(default_database)).alias("database"), schema.alias("schema"), F.col("_n.table").alias("table"), "item", "query_count",
        F.coalesce("column_count", F.lit(0)).alias("column_count"), F.when(F.col("top") > 0, F.round(100.0 * F.col("query_count") / F.col("top"), 2)).otherwise(0.0).alias("priority"), status.alias("status"),
    )


def activity_rank(counts: DataFrame, most: int) -> DataFrame:
    """The busiest items, ties by name, with their rank."""
    top = counts.orderBy(F.col("query_count").desc(), "item").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("query_count").desc(), "item")))


def importance(usage: DataFrame) -> DataFrame:
    """(item, name, log_weight, comms_weight, git_weight, score, dead): usage has uses, mentions and files for each item and name.

    Uses count against the item's most used name. An item's mentions and files are squashed to s / (10 + s) and dealt
    over its used names; an unused name gets a quarter of that share.
    """
    item = Window.partitionBy("item")
    top, used = F.max("uses").over(item), F.count_if(F.col("uses") > 0).over(item)
    share = F.when(F.col("uses") > 0, 1.0).otherwise(0.25) / F.greatest(used, F.lit(1))
    squash = lambda c: F.sum(c).over(item) / (10.0 + F.sum(c).over(item))
    rows = usage.select(
        "item", "name", F.when(top > 0, F.col("uses") / top).otherwise(0.0).alias("log_weight"), (squash("mentions") * share).alias("comms_weight"), (squash("files") * share).alias("git_weight"), (F.col("uses") == 0).alias("dead")
    )
    score = F.round(F.col("log_weight") + 0.15 * F.col("comms_weight") + 0.1 * F.col("git_weight"), 6)
    return rows.select("item", "name", F.round("log_weight", 6).alias("log_weight"), F.round("comms_weight", 6).alias("comms_weight"), F.round("git_weight", 6).alias("git_weight"), score.alias("score"), "dead")


def criticality(counts: DataFrame, degrees: DataFrame, sensitive: Column) -> DataFrame:
    """(item, lineage, usage, naming, criticality): ladders over degree and query count, 25 for a sensitive name, at most 100."""
    rows = counts.join(degrees.select(F.col("node").alias("item"), "degree"), "item", "left").na.fill(0, ["degree"])
    rows = rows.select("item", ladder(F.col("degree"), [(10, 40), (5, 25), (1, 15)], 0).alias("lineage"), ladder(F.col("query_count"), [(1000, 35), (500, 30), (200, 20), (50, 10)], 0).alias("usage"), F.when(sensitive, 25).otherwise(0).alias("naming"))
    return rows.withColumn("criticality", F.least(F.col("lineage") + F.col("usage") + F.col("naming"), F.lit(100)))


def queue(confidence: Column, criticality: Column, blocked: Column, warned: Column, floor: float = 85, ceiling: float = 50) -> Column:
    """red, yellow or green, decided in this order."""
    return F.when((criticality >= 80) | blocked | (confidence < 70), "red").when((confidence < floor) | warned, "yellow").when(criticality <= ceiling, "green").otherwise("yellow")


def queue_counts(scored: DataFrame, by: str) -> DataFrame:
    return scored.groupBy(by).agg(*(F.count_if(F.col("queue") == q).alias(q) for q in ("red", "yellow", "green")), F.count("*").alias("total"))


def domain_matrix(rows: DataFrame, domain: str, priority: str, schema: str, complexity: str | None = None) -> DataFrame:
    """(domain, tables, schemas, scaled): summed priority, the greatest domain's being 100; with mean_complexity if a column of it is named."""
    more = [F.round(F.avg(complexity), 2).alias("mean_complexity")] if complexity else []
    sums = rows.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("tables"), F.count_distinct(schema).alias("schemas"), F.sum(priority).alias("total"), *more)
    top = sums.agg(F.max("total").alias("top"))
    return sums.crossJoin(F.broadcast(top)).select("domain", "tables", "schemas", F.round(100.0 * F.col("total") / F.col("top"), 2).alias("scaled"), *(["mean_complexity"] if complexity else []))


def width_outliers(rows: DataFrame, domain: str, width: str, sigmas: float = 2.0) -> DataFrame:
    """Rows wider than their domain's mean by more than `sigmas` population deviations; domain statistics join as one small row each."""
    stats = rows.groupBy(domain).agg(F.avg(width).alias("mean"), F.stddev_pop(width).alias("deviation"))
    return rows.join(stats, domain).where(F.col(width) > F.col("mean") + sigmas * F.col("deviation")).select(*rows.columns)


def positions(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """rows with their number in an order, from 1: ranges of the order are dealt to tasks, numbered inside, and shifted by the rows of the ranges before."""
    part = free_name(rows, "_part")
    dealt = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).count()  # a row for each range
    base = free_name(rows, "_base")
    before = counts.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(base))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(before, part).withColumn(name, (inside + F.col(base)).cast("long")).drop(part, base)


def waves(rows: DataFrame, domain: str, order: list[Column | str], per_wave: int, most: int | None) -> DataFrame:
    """rows with a wave number: domains by their earliest row, each cut into chunks of per_wave; None keeps all waves, else rows of later ones go.

    Positions inside a domain and the order of (domain, chunk) pairs are ranked apart, the pairs by ranges, so nothing is sorted in one task.
    """
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(*order))).withColumn("_chunk", F.floor((F.col("_n") - 1) / per_wave))
    firsts = inside.where("_n = 1").select(domain, *[F.struct(*order).alias("_first")])
    chunks = positions(inside.select(domain, "_chunk").distinct().join(firsts, domain), ["_first", "_chunk"], "wave").withColumn("wave", F.col("wave").cast("int"))
    kept = chunks if most is None else chunks.where(F.col("wave") <= most)
    return inside.join(kept.select(domain, "_chunk", "wave"), [domain, "_chunk"]).drop("_n", "_chunk")


def decisions(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """rows with bucket: approved goes to merged with a confidence of 0.85 to 0.98, rejected to trash, the rest stays in review."""
    out = rows.join(chosen, key, "left")
    bucket = F.when(F.col("action") == "approve", "merged").when(F.col("action") == "reject", "trash").otherwise("review")
    confidence = F.when(F.col("action") == "approve", F.least(F.greatest(F.col("confidence"), F.lit(0.85)), F.lit(0.98))).otherwise(F.col("confidence"))
    return out.withColumn("confidence", confidence).withColumn("bucket", bucket).drop("action")
