"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents are laid end to end in a shuffled order and cut into blocks of equally many words. Slots of the
mix are dealt to sources by golden-ratio points: slot i's point i / phi (modulo 1) falls in the interval of one source
among intervals as wide as the sources' shares, so any stretch of slots is close to the target shares. A slot's rank
among its source's slots names the block that it takes; past the last block a source starts over. The last slot of a
source is cut so that its words match its target. Everything is DataFrame functions; ranks and positions are sums of
two levels (buckets, then rows in a bucket), so the largest source is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialize, quoted, small_side, word_count

WEIGHTS, SHARE, CAP, BLOCK_WORDS = (5, 2, 1), 1.5, 2, 4096
#: Points are multiples of GOLDEN modulo POINTS: 2**31 divided by the golden ratio, made odd.
POINTS, GOLDEN, CELL_BITS = 1 << 31, 1327217885, 21
SLOT_BITS, ROW_BUCKETS = 12, 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with src (number by code point, null last), weight and target DOUBLE.

    share times all sizes is dealt by weight; a target stops at cap times its source's size and the rest is dealt again.
    With sources in order of cap / weight that is one level: the first at which a source isn't full. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("src", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("full", cap * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    until = Window.orderBy(F.col("full") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(until), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(until), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") > F.col("level"))
    rows = rows.withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), "src", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", "src", "weight", F.least("full", F.coalesce(F.col("weight") * F.col("water"), "full")).alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(src, rank, slot) for sources (src, need, lo, hi): points lo..hi - 1 are the source's. Every source gets need slots.

    Slots beyond need are dropped; a source that the points give too few gets the missing ones after the last slot.
    """
    spark = sources.sparkSession
    cells = sources.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("u")).withColumn("cell", F.shiftright("u", CELL_BITS))
    dealt = points.join(small_side(materialize(cells)), "cell").where("u >= lo and u < hi").select("src", "slot", "need", F.shiftright("slot", SLOT_BITS).alias("bucket"))
    counts = dealt.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    base = counts.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("slot")) - 1 + F.col("base")
    ranked = dealt.join(base, ["src", "bucket"]).select("src", rank.alias("rank"), "slot", "need").where("rank < need").drop("need")
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    missing = sources.join(got, "src", "left").select("src", "need", F.coalesce("got", F.lit(0)).alias("got")).where("got < need")
    late = missing.select("src", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")).select("src", "rank", F.col("rank") + slots)
    return ranked.union(late)


def lines(rows: DataFrame) -> DataFrame:
    """rows (src, size, row_key, doc_id, ...) with start: the words before a document in its source's shuffled line, and place: a number of its own there."""
    rows = rows.withColumn("bucket", F.pmod("row_key", F.lit(ROW_BUCKETS)))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("row_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, ["src", "bucket"]).withColumn("start", F.sum("size").over(inside) - F.col("size") + F.col("base"))
    return rows.withColumn("place", F.col("bucket").cast("long") * (1 << 40) + F.row_number().over(inside)).drop("bucket", "base")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes: (doc_id, row_key, source, size, source_size, target, place, lap, first, last, slot).

    A row for each lap in which words first..last - 1 of a document are taken, slot being its first slot's place in the
    mix; one row with null lap, first, last and slot for a document of which nothing is. row_key is a hash of id, source
    and text. A source's words differ from its target by less than one. A null text has size 0; null sources form the
    last source; ids may be null or repeat, and repeated rows are documents of their own. No rows in, none out.
    """
    key = F.xxhash64("doc_id", "source", "text")
    rows = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("row_key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    of = targets(sizes, weights, share, cap).withColumn("quota", F.round("target").cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    laps = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    of = of.withColumn("blocks", blocks.cast("long")).withColumn("rest", F.when(F.col("source_size") > 0, F.col("quota") % F.col("source_size")).otherwise(0))
    of = of.withColumn("need", (laps * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    everything = Window.partitionBy()
    until = Window.orderBy("src")
    of = of.withColumn("slots", F.sum("need").over(everything)).withColumn("upto", F.sum("need").over(until))
    edge = lambda words: F.coalesce(F.floor(words / F.expr("nullif(slots, 0)") * POINTS), F.lit(0)).cast("long")
    of = materialize(of.withColumn("lo", edge(F.col("upto") - F.col("need"))).withColumn("hi", edge(F.col("upto"))))
    total = of.agg(F.max("slots")).first()[0] or 0
    slots = schedule(of.select("src", "need", "lo", "hi"), total)
    known = of.select("src", "blocks", "rest", "need", "source_size")
    slots = slots.join(small_side(known), "src").select("src", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("lap"), "slot", F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest")).otherwise(F.col("source_size")).alias("until"))
    facts = small_side(of.select(F.col("source").alias("_source"), "src", "source_size", "target"), "_source")
    placed = lines(rows.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    covers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    parts = placed.withColumn("block", F.explode_outer(covers))
    first = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("until")) - F.col("start")
    taken = parts.join(slots, ["src", "block"], "left").withColumn("first", first).withColumn("last", last)
    taken = taken.withColumn("lap", F.when(F.col("last") > F.col("first"), F.col("lap")))
    keys = ["src", "place", "doc_id", "row_key", "source", "size", "source_size", "target"]
    used = F.col("lap").isNotNull()
    pieces = taken.groupBy(*keys, "lap").agg(F.min(F.when(used, F.col("first"))).alias("first"), F.max(F.when(used, F.col("last"))).alias("last"), F.min(F.when(used, F.col("slot"))).alias("slot"))
    return pieces.select("doc_id", "row_key", "source", "size", "source_size", "target", "place", "lap", "first", "last", "slot")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per row of docs; see mix."""
    pieces = mix(docs, **how)
    keys = ["source", "place", "doc_id", "row_key", "size", "source_size", "target"]
    return pieces.groupBy(*keys).agg(F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each taken stretch of a document; its text is the whole text or those words, joined by one space.

    n_chars, where docs has it, is counted again. Rows that repeat id, source and text are told apart by their place
    among equals, in the order of their other columns, so reruns agree. Other columns may have any names.
    """
    name = {n: free_name(docs, f"_{n}") for n in ("id", "key", "size", "first", "last", "place", "row_key", "no")}
    pieces = mix(docs, **how).where("lap is not null")
    pieces = pieces.select(F.col("doc_id").alias(name["id"]), F.col("row_key").alias(name["key"]), *(F.col(n).alias(name[n]) for n in ("place", "size", "first", "last")))
    pieces = materialize(pieces)
    on = [name["id"], name["key"]]
    keyed = docs.withColumn(name["row_key"], F.xxhash64("doc_id", "source", "text"))
    of = F.col("doc_id").eqNullSafe(F.col(name["id"])) & (F.col(name["row_key"]) == F.col(name["key"]))
    if not pieces.groupBy(*on).agg(F.count_distinct(name["place"]).alias("n")).where("n > 1").isEmpty():
        number = free_name(docs, "_number")
        pieces = pieces.withColumn(number, F.dense_rank().over(Window.partitionBy(*on).orderBy(name["place"])))
        order = [F.to_json(F.struct(F.col(quoted(c)).alias("v"))) for c in docs.columns if c not in ("doc_id", "source", "text")] or [F.lit(1)]
        keyed = keyed.withColumn(name["no"], F.row_number().over(Window.partitionBy("doc_id", name["row_key"]).orderBy(*order)))
        of &= F.col(name["no"]) == F.col(number)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    first, last = F.col(name["first"]), F.col(name["last"])
    cut = F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), " ")
    out = keyed.join(pieces.hint("shuffle_hash"), of)
    out = out.withColumn("text", F.when((first == 0) & (last == F.col(name["size"])), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, docs.columns))
