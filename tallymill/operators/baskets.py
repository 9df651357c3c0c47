"""Operators on baskets: which tables a statement touches (columns stmt, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

MAX_WEIGHT, MAX_EDGES, MAX_PEERS = 10_000, 60_000, 48
#: Rows of baskets that one task pairs.
PART = 250_000


def touches(rows: DataFrame, stmt: str, item: str) -> DataFrame:
    """(stmt, item) of each row that has both, repeats included."""
    return rows.select(F.col(stmt).alias("stmt"), F.col(item).alias("item")).where("stmt is not null and item is not null")


def baskets(rows: DataFrame, stmt: str, item: str) -> DataFrame:
    """Distinct (stmt, item); rows without either are left out."""
    return touches(rows, stmt, item).distinct()


def table_counts(b: DataFrame) -> DataFrame:
    """(item, query_count): statements that touch an item."""
    return b.groupBy("item").agg(F.count("*").alias("query_count"))


def pair_weights(b: DataFrame, max_weight: int | None = MAX_WEIGHT, repeats: bool = False) -> DataFrame:
    """(a, b, weight) with a < b: statements that touch both, at most max_weight.

    Items of a statement meet by an equi-join on the statement; weights are partial sums before the shuffle. The baskets
    are written first and dealt to as many tasks as their number asks for, so a task's share does not grow with the input.
    If b may hold repeats (touches() of a table), they are counted and dealt as they are, and each statement's repeats
    go where it is paired: one shuffle, and nothing written.
    """
    b = b.select("stmt", "item") if repeats else materialize(b.select("stmt", "item"))
    b = b.repartition(max(1, -(-b.count() // PART)), "stmt")
    b = b.distinct() if repeats else b
    left, right = b.select("stmt", F.col("item").alias("a")), b.select("stmt", F.col("item").alias("b"))
    n = F.count("*")
    return left.join(right, "stmt").where("a < b").groupBy("a", "b").agg((n if max_weight is None else F.least(n, F.lit(max_weight))).cast("long").alias("weight"))


def strongest(edges: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """The heaviest edges, ties to the lesser ends."""
    return edges.orderBy(F.col("weight").desc(), "a", "b").limit(most)


def summary(b: DataFrame) -> DataFrame:
    """One row: distinct items, pairs with a weight, density of the pair matrix."""
    n = b.agg(F.count_distinct("item").alias("tables"))
    pairs = pair_weights(b).agg(F.count("*").alias("pairs"))
    density = F.when(F.col("tables") > 1, 2.0 * F.col("pairs") / (F.col("tables") * (F.col("tables") - 1))).otherwise(0.0)
    return n.crossJoin(pairs).withColumn("density", density)


def co_peers(edges: DataFrame) -> DataFrame:
    """(item, n_peers, peer_weight, best_peer): for each item all its peers, counted and weighed, and the strongest, ties to the lesser name.

    Partial aggregates, so an item's peers are never gathered or sorted in a task.
    """
    both = edges.select(F.col("a").alias("item"), F.col("b").alias("peer"), "weight").union(edges.select("b", "a", "weight"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), "peer"))["peer"]
    return both.groupBy("item").agg(F.count("*").alias("n_peers"), F.sum("weight").alias("peer_weight"), best.alias("best_peer"))


def environment(rows: DataFrame, env: str, wanted: str | None) -> DataFrame:
    """Drops a row only if a filter is set, the row has an environment, and they differ (case aside)."""
    if not (wanted or "").strip():
        return rows
    own = F.lower(F.trim(F.coalesce(F.col(env), F.lit(""))))
    return rows.where((own == "") | (own == wanted.strip().lower()))


def role_counts(rows: DataFrame, item: str, role: str, roles: list[str]) -> DataFrame:
    """A count column for each role; one pass, no pivot job."""
    return rows.groupBy(F.col(item).alias("item")).agg(*(F.count_if(F.col(role) == r).alias(r) for r in roles))


def merge_counts(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of equal counters of several partial results."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))


def merge_peers(*parts: DataFrame, most: int | None = MAX_PEERS) -> DataFrame:
    """(item, peer, weight) of several partial results: weights of equal pairs summed, the strongest `most` peers of each item kept, ties by name; None keeps all."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.where("item is not null and peer is not null").groupBy("item", "peer").agg(F.sum("weight").alias("weight"))
    if most is None:
        return sums
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("weight").desc(), "peer"))
    return sums.withColumn("_at", rank).where(F.col("_at") <= most).drop("_at")


def first_per_key(rows: DataFrame, key: Column, order: list[str], most: int | None = None, newest: bool = True) -> DataFrame:
    """rows with their key column: of each key the newest row by order (the oldest if newest is false), the newest `most` in all if stated.

    The first is a partial maximum of structs, not a window; rows equal in the order go by their other columns. Null keys are one key.
    """
    rest = [c for c in rows.columns if c not in order]
    part = F.struct(*(F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("v")).alias(c) for c in [*order, *rest]))
    best = rows.groupBy(key.alias("key")).agg((F.max if newest else F.min)(part).alias("_b"))
    out = best.select("key", *(F.col(f"_b.{c}.v").alias(c) for c in rows.columns))
    return out if most is None else out.orderBy(*((F.col(c).desc() if newest else F.col(c)) for c in order), "key").limit(most)


def telemetry(rows: DataFrame, text: Column, env: Column, wanted: str) -> DataFrame:
    """One row of ingestion counters: total, empty, of another environment, parsed."""
    empty = (F.trim(F.coalesce(text, F.lit(""))) == "") | F.startswith(F.ltrim(text), F.lit("--"))
    other = (F.coalesce(env, F.lit("")) != "") & (F.lower(env) != wanted.lower())
    return rows.select(F.coalesce(empty, F.lit(True)).alias("e"), F.coalesce(other, F.lit(False)).alias("o")).agg(
        F.count("*").alias("total"), F.count_if("e").alias("skipped_empty"), F.count_if(F.expr("o and not e")).alias("env_mismatch"), F.count_if(F.expr("not o and not e")).alias("parse_ok")
    )


def adjacent_pairs(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(token, follower, n): items directly followed by another in a key's order."""
    follower = F.lead(item).over(Window.partitionBy(key).orderBy(*order))
    pairs = rows.select(F.col(item).alias("token"), follower.alias("follower")).where("follower is not null and token is not null")
    return pairs.groupBy("token", "follower").agg(F.count("*").alias("n"))


def candidates(pairs: DataFrame, least: int = 3, k: int = 3) -> DataFrame:
    """(token, rank, follower, n): for each token its k most frequent followers seen at least `least` times."""
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("n").desc(), "follower"))
    return pairs.where(F.col("n") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select("token", "rank", "follower", "n")


def glossary(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(token, target, n, confidence, alternatives): the best follower of each token; confidence grows with its count to 0.95."""
    best = candidates(pairs, least)
    top = best.agg(F.max("n").alias("top"))
    rows = best.groupBy("token").agg(F.min(F.when(F.col("rank") == 1, F.col("follower"))).alias("target"), F.max("n").alias("n"), (F.count("*") - 1).alias("alternatives"))
    return rows.crossJoin(F.broadcast(top)).withColumn("confidence", F.least(F.lit(0.95), 0.3 + 0.65 * F.col("n") / F.col("top"))).drop("top")
