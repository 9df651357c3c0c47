"""Filters, selections and unions over inventories, mappings and name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..sources.catalogs import is_noise
from .graph import symmetric


def first_text(*columns: str) -> Column:
    """The first of several columns that isn't blank; null if all are."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in columns))


def in_scope(key: Column, target: str) -> Column:
    """A key equals the target or its last segment, or ends with a dot and that segment; case aside."""
    full = target.strip().lower()
    short = full.rpartition(".")[2]
    low = F.lower(key)
    return (low == full) | (low == short) | low.endswith(f".{short}")


def scored_rows(rows: DataFrame, queues: list[str] | None = None, domain: str | None = None, confidence: tuple[float, float] = (0, 100), criticality: tuple[float, float] = (0, 100), sort: str = "item", descending: bool = False) -> DataFrame:
    """Inventory rows (item, domain, queue, confidence, criticality) under the given filters; ties in the order go by item."""
    keep = F.col("confidence").between(*confidence) & F.col("criticality").between(*criticality)
    keep = keep & F.col("queue").isin(*queues) if queues else keep
    keep = keep & (F.col("domain") == domain) if domain else keep
    return rows.where(keep).orderBy(F.col(sort).desc() if descending else F.col(sort), "item")


def scored_query(
    rows: DataFrame, flags: DataFrame, queue: str | None = None, domain: str | None = None, schema: str | None = None, status: str | None = None, anomaly_level: str | None = None, has_blob: bool = False,
    confidence: tuple[float, float] = (0, 100), criticality: tuple[float, float] = (0, 100), sort: str = "confidence", descending: bool = True, most: int | None = None,
) -> DataFrame:
    """Scored rows (item, domain, queue, status, confidence, criticality) with their flags (ARRAY of level:name, sorted) under the given filters; ties in the order go by item.

    flags is (item, level, name). The schema is what stands before the first dot of a dotted item; it, queue, domain and
    level match whatever their case, the status as it stands. has_blob keeps items with a flag unsupported_blob_type.
    Only flags of rows that pass the other filters are gathered, a set for each item.
    """
    same = lambda c, v: F.lower(c) == v.lower()
    item = F.col("item").cast("string")
    keep = F.col("confidence").between(*confidence) & F.col("criticality").between(*criticality)
    for column, wanted in (("queue", queue), ("domain", domain)):
        keep = keep & same(F.col(column), wanted) if wanted else keep
    keep = keep & same(F.when(item.contains("."), F.substring_index(item, ".", 1)).otherwise(""), schema) if schema else keep
    keep = keep & (F.col("status") == status) if status else keep
    found = rows.where(keep)
    if anomaly_level:
        found = found.join(flags.where(same(F.col("level"), anomaly_level)).select("item"), "item", "left_semi")
    if has_blob:
        found = found.join(flags.where("name = 'unsupported_blob_type'").select("item"), "item", "left_semi")
    said = flags.join(found.select("item"), "item", "left_semi").groupBy("item").agg(F.sort_array(F.collect_set(F.concat_ws(":", "level", "name"))).alias("flags"))
    out = found.join(said, "item", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    out = out.orderBy(F.col(sort).desc() if descending else F.col(sort), "item")
    return out if most is None else out.limit(most)


def table_search(
    rows: DataFrame, text: str = "", columns: tuple[str, ...] = ("item",), domain: str | None = None, queues: list[str] | None = None, done: DataFrame | None = None,
    least_confidence: float | None = None, most_criticality: float | None = None, sort: str = "item", descending: bool = False, most: int | None = None,
) -> DataFrame:
    """Rows (item, domain, queue, confidence, criticality, ...) under the filters of an interactive search; a filter that isn't stated lets all pass.

    The text stands in one of the columns, case aside; rows of done (item) are left out; a null confidence or
    criticality fails a bound. Ties in the order go by item.
    """
    keep = F.lit(True)
    if text:
        keep = F.exists(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)), lambda v: F.coalesce(F.contains(v, F.lit(text.lower())), F.lit(False)))
    keep = keep & (F.col("domain") == domain) if domain else keep
    keep = keep & F.col("queue").isin(queues) if queues else keep
    keep = keep & (F.col("confidence") >= least_confidence) if least_confidence is not None else keep
    keep = keep & (F.col("criticality") <= most_criticality) if most_criticality is not None else keep
    found = rows.where(keep)
    found = found if done is None else found.join(done.select("item").distinct(), "item", "left_anti").select(*rows.columns)
    found = found.orderBy(F.col(sort).desc() if descending else F.col(sort), "item")
    return found if most is None else found.limit(most)


def bulk_split(selected: DataFrame, queues: DataFrame, asked: str = "green", dry_run: bool = False) -> DataFrame:
    """(item, proceed, reason): green items proceed, others are skipped with their queue named, unknown ones as unknown.

    A bulk of the red queue is refused: one row * that doesn't proceed. A dry run decides nothing and has no rows.
    """
    if asked.lower() == "red":
        return selected.sparkSession.createDataFrame([("*", False, "a bulk of the red queue is refused")], "item string, proceed boolean, reason string")
    rows = selected.select("item").distinct().join(queues.select("item", "queue"), "item", "left")
    queue = F.coalesce("queue", F.lit("unknown"))
    out = rows.select("item", (queue == "green").alias("proceed"), F.when(queue != "green", F.concat(F.lit("queue is "), queue)).alias("reason"))
    return out.limit(0) if dry_run else out


def high_risk(hot: DataFrame, inventory: DataFrame, importance: DataFrame, priority: float = 70, score: float = 0.35) -> DataFrame:
    """(item): hotspots, items of high priority, and items that have an important column; each once."""
    return hot.select("item").union(inventory.where(F.col("priority") >= priority).select("item")).union(importance.where(F.col("score") >= score).select("item")).distinct()


def columns_by_usage(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """(table_key, col, in_catalog, in_use): all catalog columns and the used names that it lacks, matched with case aside."""
    low = lambda df, flag: df.groupBy("table_key", F.lower("col").alias("_k")).agg(F.min("col").alias(f"_{flag}"))
    rows = low(catalog, "c").join(low(used, "u"), ["table_key", "_k"], "full")
    return rows.select("table_key", F.coalesce("_c", "_u").alias("col"), F.col("_c").isNotNull().alias("in_catalog"), F.col("_u").isNotNull().alias("in_use"))


def layered_glossary(entries: DataFrame) -> DataFrame:
    """(term, target, layer): entries (layer, term, target) with the lowest layer for each normalised term; terms with a leading _ are notes."""
    key = name_key(F.col("term"))
    rows = entries.where(~F.startswith("term", F.lit("_")) & (key != "")).groupBy(key.alias("term")).agg(F.min(F.struct("layer", "target")).alias("b"))
    return rows.select("term", F.col("b.target").alias("target"), F.col("b.layer").alias("layer"))


def ordered_union(*parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, part, order): the first occurrence of each key over parts in order, blank and null keys left out."""
    rows = parts[0].select(key, F.lit(0).alias("part"), order)
    for i, p in enumerate(parts[1:], 1):
        rows = rows.union(p.select(key, F.lit(i), order))
    first = rows.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.min(F.struct("part", order)).alias("f"))
    return first.select(key, "f.part", F.col(f"f.{order}").alias(order))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """(key, digest, change): entries (key, content) against stored (key, digest): added, changed, same or removed by SHA-256."""
    now = new.select("key", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    rows = now.join(old.select("key", F.col("digest").alias("_old")), "key", "full")
    change = F.when(F.col("digest").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("digest") == F.col("_old"), "same").otherwise("changed")
    return rows.select("key", F.coalesce("digest", "_old").alias("digest"), change.alias("change"))


def confidence_scores(columns: DataFrame) -> DataFrame:
    """(item, confidence): 70 points by matched and 30 by typed columns, each rounded half to even; columns is (item, matched, typed)."""
    points = lambda most, c: F.bround(most * F.count_if(c) / F.count("*"), 0)
    return columns.groupBy("item").agg(F.least(points(70.0, "matched") + points(30.0, "typed"), F.lit(100.0)).cast("int").alias("confidence"))


def tickets(planned: DataFrame, texts: DataFrame, longest: int | None = 1500) -> DataFrame:
    """(kind, summary, parent, description): an epic for each wave, a story for each of its items, descriptions cut to `longest`, or whole if it is None."""
    epic = F.concat(F.lit("Wave "), F.col("wave").cast("string"))
    waves = planned.groupBy("wave").agg(F.count("*").alias("n")).select(F.lit("Epic").alias("kind"), epic.alias("summary"), F.lit("").alias("parent"), F.concat(F.col("n").cast("string"), F.lit(" table(s)")).alias("description"))
    items = planned.select("item", "wave").join(texts.select("item", "text"), "item", "left")
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*[\r\n]+\s*", " / ")
    cut = F.substring(flat, 1, longest) if longest else flat
    return waves.unionByName(items.select(F.lit("Story").alias("kind"), F.concat(F.lit("Migrate "), F.col("item").cast("string")).alias("summary"), epic.alias("parent"), cut.alias("description")))


def history(rows: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """The latest rows (ran_at, sql) between two days, both included, newest first; a statement counts once, at its last time."""
    inside = rows.where((F.col("ran_at") >= F.lit(start).cast("timestamp")) & (F.col("ran_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")) & (F.trim("sql") != ""))
    return inside.groupBy("sql").agg(F.max("ran_at").alias("ran_at")).orderBy(F.col("ran_at").desc(), "sql").limit(most)


def batches(scripts: DataFrame) -> DataFrame:
    """(script, pos, sql): scripts (script, text) cut at lines that hold only GO; blank parts and noise go, see is_noise()."""
    parts = scripts.select("script", F.posexplode(F.split("text", r"(?im)^[ \t]*GO[ \t]*\r?$")).alias("pos", "sql")).withColumn("sql", F.regexp_replace("sql", r"\A\s+|\s+\z", ""))
    return parts.where(~is_noise(F.col("sql")))


def lint(log: DataFrame) -> DataFrame:
    """(stmt, is_select, has_filter, placeholder, casts): what a statement's text shows."""
    one = lambda p: F.coalesce(F.col("sql").rlike(p), F.lit(False))
    casts = F.coalesce(F.regexp_count("sql", F.lit(r"(?i)\bcast\s*\([^()]*\bas\s+(text|ntext|image|sql_variant)\b")), F.lit(0))
    return log.select("stmt", one(r"(?i)\A\s*(select|with)\b").alias("is_select"), one(r"(?i)\bwhere\b").alias("has_filter"), one(r"(?i)\bselect\s+(1|null|\*)\s+from\b").alias("placeholder"), casts.alias("casts"))


def file_score(text: Column, schema: str, table: str) -> Column:
    """4 for each schema.table, 2 for each table, 1.5 for each FROM or JOIN of it; case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    times = lambda k: F.regexp_count(low, F.lit(rf"\Q{k}\E"))
    named = F.regexp_count(low, F.lit(rf"\b(?:from|join)\s+(?:[a-z_][a-z0-9_]*\.)*\Q{table.lower()}\E\b"))
    return 4.0 * times(f"{schema}.{table}".lower()) + 2.0 * times(table.lower()) + 1.5 * named


def two_layer_neighbourhood(keys: DataFrame, edges: DataFrame, centre: int | str) -> DataFrame:
    """(other, kind, shared): nodes tied to a centre by a key (child, parent) or by statements (a, b, weight), each with the shared count."""
    used = symmetric(edges).where(F.col("src") == centre).select(F.col("dst").alias("other"), "weight")
    tied = keys.where(F.col("child") == centre).select(F.col("parent").alias("other")).union(keys.where(F.col("parent") == centre).select("child")).distinct().withColumn("_k", F.lit(True))
    rows = used.join(tied, "other", "full")
    kind = F.when(F.col("_k").isNotNull() & F.col("weight").isNotNull(), "both").when(F.col("_k").isNotNull(), "key").otherwise("coquery")
    return rows.select("other", kind.alias("kind"), F.coalesce("weight", F.lit(0)).alias("shared"))


def nearest(corpus: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one stated vector by cosine, ties to the lesser id: a scan and a top-k, in doubles. Null or zero vectors score null and come last."""
    v = F.col(vector_col).cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in vector))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot, norm = total(F.zip_with(v, q, lambda x, y: x * y)), F.sqrt(total(F.transform(v, lambda x: x * x)))
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    score = F.when((norm > 0) & F.lit(length > 0), F.round(dot / (norm * length), 6))
    return corpus.select(id_col, score.alias("score")).orderBy(F.col("score").desc_nulls_last(), id_col).limit(k)
