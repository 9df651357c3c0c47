"""Mapping of the names used in statements to the columns of a catalog, and reports on the mapping.

Usage is (table_key, name, n_select, n_where, n_join); the catalog (table_key, col); a glossary (term, target). A mapping
has usage's columns and target, confidence, strategy, needs_review and bucket (merged, review or trash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import low_signal, name_key, normalize_name
from ..plans.scratch import materialize

FLOOR, CONFIRMED = 0.4, 0.8
#: Columns of a table that are scored pair by pair; columns that a search returns.
PAIRWISE, NEAREST = 256, 8
BOOSTED, BOOST = 24, 0.14
USES = ("n_select", "n_where", "n_join")


def by_glossary(names: DataFrame, glossary: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table_key, name, target): names in the glossary whose target is a column of their own table."""
    terms = glossary.groupBy(name_key(F.col("term")).alias("key")).agg(F.min("target").alias("target"))
    hits = names.withColumn("key", name_key(F.col("name"))).join(terms, "key")
    return hits.join(catalog.select("table_key", F.col("col").alias("target")).distinct(), ["table_key", "target"], "left_semi").select("table_key", "name", "target")


def by_equality(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table_key, name, target): names equal to a column of their table once both are normalised."""
    columns = catalog.groupBy("table_key", name_key(F.col("col")).alias("key")).agg(F.min("col").alias("target"))
    return names.withColumn("key", name_key(F.col("name"))).join(columns, ["table_key", "key"]).select("table_key", "name", "target")


def nearest_names(names: DataFrame, catalog: DataFrame, k: int = NEAREST) -> DataFrame:
    """(table_key, name, col, score): the k columns of a name's table nearest to it by the product of unit vectors, ties to the lesser column."""
    left = names.select("table_key", "name", N.hash_vector(F.concat(F.lit("log column identifier observed: "), F.col("name"))).alias("_x"))
    right = catalog.select("table_key", "col", N.hash_vector(F.concat(F.lit("DDL column canonical identifier: "), normalize_name(F.col("col")))).alias("_y"))
    pairs = left.join(right, "table_key").select("table_key", "name", "col", N.dot(F.col("_x"), F.col("_y")).alias("score"))
    order = Window.partitionBy("table_key", "name").orderBy(F.desc("score"), "col")
    return pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def candidates(names: DataFrame, catalog: DataFrame, keep: int | None = BOOSTED) -> DataFrame:
    """(table_key, name, col, product, low, high): the columns of each name's table that can be its best by blended score, or among the `keep` best of an ambiguous name.

    Vectors, character counts and their products are built-in functions on rows made once for each name and column. low
    and high bound the score, from bounds of the lexical ratio; a column whose high bound is below the largest low bound of
    its name (the keep-th of an ambiguous one) is out, and only the others reach the matching blocks in Python. None keeps all.
    """
    left = names.select("table_key", "name", N.hash_vector(F.concat(F.lit("log column identifier: "), F.col("name"))).alias("_x"), N.character_counts(F.col("name")).alias("_m"))
    right = catalog.select("table_key", "col", N.hash_vector(F.concat(F.lit("DDL column canonical: "), F.col("col"))).alias("_y"), N.character_counts(F.col("col")).alias("_n"))
    met = left.join(right, "table_key").select("table_key", "name", "col", (0.55 * N.dot(F.col("_x"), F.col("_y"))).alias("product"), N.ratio_bounds(F.col("name"), F.col("col"), F.col("_m"), F.col("_n")).alias("_b"))
    met = materialize(met.select("table_key", "name", "col", "product", F.least(F.lit(1.0), F.col("product") + 0.45 * F.col("_b.low")).alias("low"), F.least(F.lit(1.0), F.col("product") + 0.45 * F.col("_b.high")).alias("high")))
    if keep is None:
        return met
    doubtful = F.coalesce(N.ambiguous(normalize_name(F.col("name"))), F.lit(False))
    floors = met.where(~doubtful).groupBy("table_key", "name").agg(F.max("low").alias("floor"))
    rank = F.row_number().over(Window.partitionBy("table_key", "name").orderBy(F.col("low").desc()))
    floors = floors.union(met.where(doubtful).withColumn("_rank", rank).where(F.col("_rank") == keep).select("table_key", "name", "low"))
    # Rounding may differ by a bit between a bound and the score itself.
    return met.join(floors, ["table_key", "name"], "left").where("floor is null or high >= floor - 1e-9").drop("floor")


def blended(names: DataFrame, catalog: DataFrame, pairwise: int = PAIRWISE, best: bool = False) -> DataFrame:
    """(table_key, name, col, score): 0.55 of the vector product and 0.45 of the lexical ratio, for each name and each column of its table; if best, only for columns that candidates() leaves.

    In a table of more than `pairwise` columns a name has one row: its nearest column, scored with the best lexical
    ratio to any.
    """
    wide = catalog.groupBy("table_key").agg(F.count("*").alias("n")).where(F.col("n") > pairwise).select("table_key")
    many, catalog = catalog.join(wide, "table_key", "left_semi"), catalog.join(wide, "table_key", "left_anti")
    lexical = F.max(N.lexical_ratio(F.col("name"), F.col("col"))).alias("_lexical")
    likest = names.join(many, "table_key").groupBy("table_key", "name").agg(lexical)
    found = nearest_names(names, many, 1).join(likest, ["table_key", "name"])
    found = found.select("table_key", "name", "col", F.least(F.lit(1.0), 0.55 * F.col("score") + 0.45 * F.col("_lexical")).alias("score"))
    score = F.least(F.lit(1.0), F.col("product") + 0.45 * N.lexical_ratio(F.col("name"), F.col("col")))
    rows = candidates(names, catalog, keep=BOOSTED if best else None)
    return materialize(rows).select("table_key", "name", "col", score.alias("score")).union(found)


def best_blended(names: DataFrame, catalog: DataFrame) -> DataFrame:
    return blended(names, catalog, best=True)


def scored(score: N.Score):
    """The same shape as blended(), by a score of built-in functions."""

    def pairs(names: DataFrame, catalog: DataFrame) -> DataFrame:
        return names.join(catalog, "table_key").select("table_key", "name", "col", score(F.col("name"), F.col("col")).alias("score"))

    return pairs


def best_candidate(pairs: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """(table_key, name, target, score): the best column of each name, ties to the lesser column.

    Peers (table_key, name, peer) are names used together: an ambiguous name's 24 best columns are ranked anew, with
    0.14 more for a column that contains a peer or is contained in one. The score itself stays. The best is a partial
    aggregate; only ambiguous names are ranked by a window.
    """
    plain = pairs.withColumn("rank_score", F.col("score"))
    if peers is not None:
        doubtful = N.ambiguous(normalize_name(F.col("name")))
        rank = F.row_number().over(Window.partitionBy("table_key", "name").orderBy(F.col("score").desc(), "col"))
        few = pairs.where(doubtful).withColumn("_rank", rank).where(F.col("_rank") <= BOOSTED).drop("_rank")
        low, peer = F.lower("col"), F.lower(normalize_name(F.col("peer")))
        near = few.join(peers, ["table_key", "name"]).where((peer != "") & (F.contains(low, peer) | F.contains(peer, low))).select("table_key", "name", "col").distinct()
        few = few.join(near.withColumn("_near", F.lit(BOOST)), ["table_key", "name", "col"], "left").withColumn("rank_score", F.col("score") + F.coalesce("_near", F.lit(0.0))).drop("_near")
        plain = plain.where(~F.coalesce(doubtful, F.lit(False))).unionByName(few)
    top = plain.groupBy("table_key", "name").agg(F.min(F.struct((-F.col("rank_score")).alias("r"), "col", "score")).alias("b"))
    return top.select("table_key", "name", F.col("b.col").alias("target"), F.col("b.score").alias("score"))


def resolve_names(usage: DataFrame, catalog: DataFrame, glossary: DataFrame, pairs=best_blended, peers: DataFrame | None = None, floor: float = FLOOR, confirmed: float = CONFIRMED) -> DataFrame:
    """The mapping of all names: glossary, else equality, else the best candidate.

    A name that says nothing keeps 0.35 of its score; a right-to-left name without glossary or equality stays below the
    floor. Only names left over by the first two steps meet the columns of their table. A null name is left out; a name
    of a table without catalog has a null target and goes to trash.
    """
    usage = usage.where("name is not null and table_key is not null")
    names, catalog = usage.select("table_key", "name").distinct(), catalog.select("table_key", "col").where("col is not null").distinct()
    listed, equal = by_glossary(names, glossary, catalog).withColumnRenamed("target", "_g"), by_equality(names, catalog).withColumnRenamed("target", "_e")
    known = names.join(listed, ["table_key", "name"], "left").join(equal, ["table_key", "name"], "left")
    rest = known.where("_g is null and _e is null").select("table_key", "name")
    rows = known.join(best_candidate(pairs(rest, catalog), peers), ["table_key", "name"], "left")
    sure = F.col("_g").isNotNull() | F.col("_e").isNotNull()
    guess = F.least(F.greatest(F.coalesce("score", F.lit(0.0)) * F.when(low_signal(F.col("name")), 0.35).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    guess = F.when(N.is_rtl(F.col("name")), F.least(guess, F.lit(floor * 0.8))).otherwise(guess)
    confidence = F.round(F.when(F.col("_g").isNotNull(), 0.95).when(F.col("_e").isNotNull(), 0.98).otherwise(guess), 6)
    strategy = F.when(F.col("_g").isNotNull(), "glossary").when(F.col("_e").isNotNull(), "exact").otherwise("blended")
    rows = rows.select("table_key", "name", F.coalesce("_g", "_e", "target").alias("target"), confidence.alias("confidence"), strategy.alias("strategy"), sure.alias("_sure"))
    bucket = F.when(F.col("_sure"), "merged").when(N.is_rtl(F.col("name")) | (F.col("confidence") < floor), "trash").when(F.col("confidence") >= confirmed, "merged").otherwise("review")
    rows = rows.withColumn("needs_review", F.col("confidence") < CONFIRMED).withColumn("bucket", bucket).drop("_sure")
    return usage.join(rows, ["table_key", "name"])


def merged(mapping: DataFrame) -> DataFrame:
    """(table_key, target, uses, confidence, needs_review, sources, strategies): merged names by the column that they mean.

    Lists are bounded by the distinct spellings of a column and sorted.
    """
    lists = [F.array_join(F.sort_array(F.collect_set(c)), ", ").alias(a) for c, a in (("name", "sources"), ("strategy", "strategies"))]
    m = mapping.where("bucket = 'merged'").groupBy("table_key", "target")
    return m.agg(*(F.sum(c).alias(c) for c in USES), F.max("confidence").alias("confidence"), F.bool_or("needs_review").alias("needs_review"), *lists)


def citations(mapping: DataFrame) -> DataFrame:
    """(table_key, target, citations): for each merged column the names that were merged into it, how and how surely, sorted, as one text.

    A citation is name→target: strategy, confidence. Their number is bounded by a column's distinct spellings.
    """
    said = F.concat("name", F.lit("→"), "target", F.lit(": "), "strategy", F.lit(", "), F.format_string("%.6f", "confidence"))
    m = mapping.where("bucket = 'merged' and target is not null").groupBy("table_key", "target")
    return m.agg(F.array_join(F.sort_array(F.collect_set(said)), "; ").alias("citations"))


def first_mappings(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows without those that follow another of the same table_key and target in an order; null targets are one target. The first is a partial minimum, so a hot target is no window."""
    rest = [c for c in rows.columns if c not in ("table_key", "target")]
    ranks = [F.struct(F.col(c).isNotNull().alias("some"), F.col(c)) if isinstance(c, str) else c for c in order]
    best = rows.groupBy("table_key", "target").agg(F.min_by(F.struct(*rest), F.struct(*ranks)).alias("_b"))
    return best.select(*(F.col(f"_b.{c}") if c in rest else F.col(c) for c in rows.columns))


def signature(table: Column, name: Column, target: Column) -> Column:
    """SHA-256 of table|name|target, nulls as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (table, name, target))), 256)


def apply_decisions(mapping: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mapping after review: chosen is (signature, action, queue), at most one row a signature.

    approved merges with a confidence of 0.85 to 0.98; rejected goes to trash; without an action a green queue merges
    and a queue that is neither green nor yellow rejects; everything else stays.
    """
    sig = signature(F.col("table_key"), F.col("name"), F.col("target"))
    rows = mapping.withColumn("signature", sig).join(chosen.select("signature", F.lower(F.trim("action")).alias("_a"), F.lower(F.trim("queue")).alias("_q")), "signature", "left")
    decision = F.when(F.col("_a") == "approved", "merged").when(F.col("_a") == "rejected", "trash").when(F.col("_a").isNull() & F.col("_q").isNotNull(), F.when(F.col("_q") == "green", "merged").when(F.col("_q") == "yellow", "review").otherwise("trash"))
    new = F.when(F.col("bucket") == "review", F.coalesce(decision, F.lit("review"))).otherwise(F.col("bucket"))
    moved = F.col("bucket") != F.col("_new")
    rows = rows.withColumn("_new", new)
    clamp = F.when(moved & (F.col("_new") == "merged"), F.least(F.greatest("confidence", F.lit(0.85)), F.lit(0.98))).otherwise(F.col("confidence"))
    category = F.when(moved & (F.col("_new") == "trash"), "hitl_rejected").when(moved, "hitl_approved").otherwise(F.col("_new"))
    return rows.withColumn("confidence", clamp).withColumn("category", category).withColumn("bucket", F.col("_new")).drop("_new", "_a", "_q", "signature")


def impact_rows(merged_rows: DataFrame, importance: DataFrame, volume: DataFrame) -> DataFrame:
    """(label, table_key, target, confidence, importance, query_volume): importance is (table_key, col, score), volume (table_key, query_count); missing ones count 0."""
    rows = merged_rows.join(importance.select("table_key", F.col("col").alias("target"), "score"), ["table_key", "target"], "left").join(volume, "table_key", "left")
    return rows.select(F.concat("table_key", F.lit(" :: "), "target").alias("label"), "table_key", "target", "confidence", F.coalesce("score", F.lit(0.0)).alias("importance"), F.coalesce("query_count", F.lit(0)).alias("query_volume"))


def migration_map(mapping: DataFrame, importance: DataFrame) -> DataFrame:
    """(section, table_key, target, legacy, confidence, importance, strategy): confirmed columns, then names in review.

    Sort the result by sort_map() where order matters.
    """
    sure = merged(mapping).select(F.lit("Confirmed").alias("section"), "table_key", "target", F.col("sources").alias("legacy"), "confidence", F.col("strategies").alias("strategy"))
    open_ = mapping.where("bucket = 'review'").select(F.lit("Review").alias("section"), "table_key", "target", F.col("name").alias("legacy"), "confidence", "strategy")
    out = sure.unionByName(open_).join(importance.select("table_key", F.col("col").alias("target"), "score"), ["table_key", "target"], "left")
    return out.select("section", "table_key", "target", "legacy", "confidence", F.coalesce("score", F.lit(0.0)).alias("importance"), "strategy")


def sort_map(rows: DataFrame) -> DataFrame:
    sure = F.col("section") == "Confirmed"
    return rows.orderBy("table_key", "section", F.when(sure, -F.col("importance")).otherwise(-F.col("confidence")), F.when(sure, F.col("target")).otherwise(F.col("legacy")))


def term_cards(mapping: DataFrame, glossary: DataFrame, domains: DataFrame) -> DataFrame:
    """(kind, term, legacy, target, confidence, domain, table_key): a card for each confirmed column, each name in review and each glossary entry."""
    m = merged(mapping).select(F.lit("confirmed").alias("kind"), F.col("sources").alias("legacy"), "target", "confidence", "table_key")
    r = mapping.where("bucket = 'review'").select(F.lit("review").alias("kind"), F.col("name").alias("legacy"), "target", "confidence", "table_key")
    mapped = m.unionByName(r).join(domains.select("table_key", "domain"), "table_key", "left")
    g = glossary.select(F.lit("glossary_source").alias("kind"), F.col("term").alias("legacy"), "target", F.lit(1.0).alias("confidence"), F.lit("").alias("table_key"), F.lit("Glossary inventory").alias("domain"))
    cards = mapped.unionByName(g)
    named = F.when(F.coalesce("target", F.lit("")) != "", N.humanize(F.col("target"))).otherwise(F.col("legacy"))
    return cards.select("kind", named.alias("term"), "legacy", "target", "confidence", F.coalesce("domain", F.lit("")).alias("domain"), "table_key")


def grouped_cards(cards: DataFrame) -> DataFrame:
    """(kind, target, legacy, term, tables, domains, confidence, cards): equal cards of several tables as one; lists are distinct and sorted.

    Lists hold a name for each table of one card, so they are bounded by the catalog, not by the log.
    """
    key = [F.col("kind"), F.lower(F.trim("target")).alias("target"), F.trim("legacy").alias("legacy"), F.trim("term").alias("term")]
    listed = lambda c: F.sort_array(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))
    return cards.groupBy(*key).agg(listed("table_key").alias("tables"), listed("domain").alias("domains"), F.max("confidence").alias("confidence"), F.count("*").alias("cards"))


def mapping_index(groups: DataFrame) -> DataFrame:
    """A line for each grouped card: number and names of its tables, the primary one if single, domains, confidence, status."""
    n = F.size("tables")
    status = F.when(F.col("kind") == "confirmed", "Confirmed").when(F.col("kind") == "review", "Needs review").when(F.col("kind") == "glossary_source", "Glossary file").otherwise(F.col("kind"))
    primary = F.when(n == 1, F.try_element_at("tables", F.lit(1))).when(n > 1, "(multiple)").otherwise("-")
    return groups.select("term", F.array_join("domains", ", ").alias("domain"), "target", "legacy", n.alias("n_tables"), F.array_join("tables", ", ").alias("tables"), primary.alias("primary"), F.round("confidence", 4).alias("confidence"), status.alias("status"))


def bucket_counts(mapping: DataFrame, *by: str) -> DataFrame:
    """n_merged, n_review, n_trash and the share of merged names in percent, for all rows or by columns."""
    n = {b: F.count_if(F.col("bucket") == b) for b in ("merged", "review", "trash")}
    share = F.when(F.count("*") > 0, F.round(100.0 * n["merged"] / F.count("*"), 2)).otherwise(0.0)
    return mapping.groupBy(*by).agg(*(c.alias(f"n_{b}") for b, c in n.items()), share.alias("pct_confirmed"))


def domain_risk(mapping: DataFrame, importance: DataFrame, domains: DataFrame, debt: str = "Technical Debt") -> DataFrame:
    """(domain, n_merged, n_review, n_trash, pct_confirmed, avg_importance, risk): risk is Low from 70 % confirmed, Medium from 40 %; debt is always High."""
    counts = bucket_counts(mapping.join(domains, "table_key"), "domain")
    mean = importance.join(domains, "table_key").groupBy("domain").agg(F.round(F.avg("score"), 4).alias("avg_importance"))
    risk = F.when(F.col("domain") == debt, "High").when(F.col("pct_confirmed") >= 70, "Low").when(F.col("pct_confirmed") >= 40, "Medium").otherwise("High")
    return counts.join(mean, "domain", "left").na.fill(0.0, ["avg_importance"]).withColumn("risk", risk)


def executive_metrics(mapping: DataFrame, importance: DataFrame) -> DataFrame:
    """(metric, value): one row a figure; importance is (table_key, col, score, dead)."""
    m = bucket_counts(mapping).crossJoin(importance.agg(F.count("*").alias("columns"), F.count_if("dead").alias("dead"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 4).alias("total")))
    share = lambda c: F.when(F.col("columns") > 0, F.round(100.0 * F.col(c) / F.col("columns"), 2)).otherwise(0.0)
    figures = [("columns", F.col("columns")), ("confirmed", F.col("n_merged")), ("pct_confirmed", share("n_merged")), ("review", F.col("n_review")), ("trash", F.col("n_trash")), ("dead", F.col("dead")), ("pct_dead", share("dead")), ("total_importance", F.col("total"))]
    cells = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in figures))
    return m.select(F.explode(cells).alias("c")).select("c.*")


def top_confidence(mapping: DataFrame) -> DataFrame:
    """(table_key, confidence): the best of all buckets."""
    return mapping.groupBy("table_key").agg(F.max("confidence").alias("confidence"))


def merge_scope(mapping: DataFrame, all_tables: DataFrame) -> DataFrame:
    """(mode, tables_merged, tables): how much of the listed tables the merge covered."""
    done = mapping.where("bucket = 'merged'").agg(F.count_distinct("table_key").alias("tables_merged"))
    rows = done.crossJoin(all_tables.agg(F.count_distinct("table_key").alias("tables")))
    mode = F.when(F.col("tables_merged") == 0, "none").when(F.col("tables_merged") == 1, "single_table").when(F.col("tables_merged") < F.col("tables"), "several_tables").otherwise("all_tables")
    return rows.select(mode.alias("mode"), "tables_merged", "tables")


def unmapped(mapping: DataFrame) -> DataFrame:
    """(item, name, uses, category) of names that were not merged, ready for importance()."""
    return mapping.where("bucket <> 'merged'").select(F.col("table_key").alias("item"), "name", (F.col("n_select") + F.col("n_where") + F.col("n_join")).alias("uses"), F.lit(0).alias("mentions"), F.lit(0).alias("files"), F.col("bucket").alias("category"))


def rename_mapping(names: DataFrame, registry: DataFrame, glossary: DataFrame) -> DataFrame:
    """(name, alias, source, confidence, warning): registry, else glossary, else transliteration; a transliterated Hebrew name gets 0.55 and a warning."""
    key = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    rows = key.join(registry.select("name", F.col("alias").alias("_r")), "name", "left").join(glossary.select(F.col("term").alias("name"), F.col("target").alias("_g")), "name", "left")
    listed = F.trim(F.coalesce("_g", F.lit(""))) != ""
    doubt = ~listed & N.is_hebrew(F.col("name"))
    alias = F.when(F.col("_r").isNotNull(), F.col("_r")).when(listed, N.transliterate(F.trim("_g"))).otherwise(N.transliterate(F.col("name")))
    return rows.select("name", alias.alias("alias"), F.when(listed, "glossary").otherwise("transliteration").alias("source"), F.when(doubt, 0.55).otherwise(1.0).alias("confidence"), doubt.alias("warning"))


def concept_hits(texts: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """(query, key): rows of texts (key, text) that contain one of a query's words, case aside, once for each query.

    The stated queries become one filter each over a single scan; nothing is joined.
    """
    low = F.lower("text")

    def hit(query: str, words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w.lower())) if w else found
        return F.when(found, F.lit(query))

    found = F.explode(F.array_compact(F.array(*(hit(q, words) for q, words in concepts.items()))))
    return texts.select("key", found.alias("query")).distinct()
