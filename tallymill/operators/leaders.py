"""Leader clustering: in a given order, a row joins the first leader at a cosine of the threshold or more, else it leads.

The result is that of the sequential loop, computed in rounds over prefixes of the order. A round takes the rows of the
next prefix that no leader has claimed yet. Pairs among them at the threshold are found by tiles of a blocked product; a
row without an earlier undecided neighbour leads, its later neighbours don't, until all of the prefix are decided. Then
the new leaders meet all rows that are left, again by tiles, and each row that reaches one joins the first. Prefixes
double: the first leaders claim the crowded parts of the space, so what is left for later, longer prefixes has few
neighbours, and rounds are logarithmic in the number of rows.

Tiles meet by an equi-join of block numbers, hold BLOCK rows a side, and put out pairs at the threshold alone (or one
leader a row), so no task or driver holds a cluster. All work is exact, the product quadratic in rows that stay alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import drop_scratch, materialize
from .scoring import positions

THRESHOLD, FIRST, BLOCK, CHUNK = 0.88, 2048, 2048, 256
#: Blocks of a side where leaders meet rows, as long as a block's vectors stay below SIDE_BYTES.
SIDES, SIDE_BYTES = 16, 16 << 20


def units(rows: DataFrame, order: str, vec: str) -> DataFrame:
    """(order, vec ARRAY<DOUBLE>) of the rows that take part, at length one: a zero vector stays zero and reaches nobody."""
    v = F.col(vec).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fit = rows.where(F.col(order).isNotNull() & v.isNotNull() & ~F.exists(v, bad)).select(F.col(order).alias("order"), v.alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return fit.select("order", norm.alias("norm"), "vec").select("order", F.transform("vec", lambda x: x / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("vec"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows at the threshold: the product finds them, a sum in a fixed order decides, whatever the tile's shape."""
    found = [np.stack(np.nonzero(x[at : at + CHUNK] @ y.T >= threshold - 1e-9)) + np.array([[at], [0]]) for at in range(0, len(x), CHUNK)]
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    sure = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        sure[part] = (x[i[part]] * y[j[part]]).sum(axis=1) >= threshold
    return i[sure], j[sure]


def _blocks(n: int, dim: int) -> int:
    """Blocks of n rows where few pairs reach the threshold: SIDES, unless that makes them smaller than BLOCK rows or larger than SIDE_BYTES."""
    rows = min(max(BLOCK, -(-n // SIDES)), max(BLOCK, SIDE_BYTES // (8 * max(1, dim))))
    return max(1, -(-n // rows))


def _tiles(left: DataFrame, right: DataFrame, n_left: int, n_right: int, threshold: float, first_only: bool, dim: int = 1) -> DataFrame:
    """(a, b): numbers of rows of left and right (n, dim, vec), a < b, at the threshold.

    first_only: the least a of each b in a tile, for leaders, which are far from each other; blocks may be large, so that
    rows are copied seldom. Otherwise left and right are the same rows, and every two blocks meet once.
    """
    p, q = (_blocks(n_left, dim), _blocks(n_right, dim)) if first_only else (max(1, -(-n_left // BLOCK)), max(1, -(-n_right // BLOCK)))
    block = lambda m: F.pmod(F.xxhash64("n"), F.lit(m)).cast("int")
    copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one = left.select("n", "dim", "vec", block(p).alias("p")).withColumn("q", copies(q))
    two = right.toDF(*right.columns).select("n", "dim", "vec", block(q).alias("q")).withColumn("p", copies(p))
    if not first_only:
        one, two = one.where("p <= q"), two.where("p <= q")

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if len(s) and len(t) and s.column("dim")[0].as_py():
            i, j = _near(_matrix(s.column("vec")), _matrix(t.column("vec")), threshold)
            a, b = s.column("n").to_numpy()[i], t.column("n").to_numpy()[j]
            if not first_only:
                a, b = np.minimum(a, b), np.maximum(a, b)
                if s.column("p")[0].as_py() == t.column("q")[0].as_py():
                    both = np.unique(np.stack((a, b)), axis=1)
                    a, b = both[0], both[1]
            a, b = a[a < b], b[a < b]
            if first_only and len(b):
                at = np.lexsort((a, b))
                at = at[np.append(True, np.diff(b[at]) != 0)]
                a, b = a[at], b[at]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["dim", "p", "q"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(run, "a bigint, b bigint")


def _led(pairs: DataFrame) -> DataFrame:
    """(n) of the rows that don't lead, for pairs (a, b), a < b: a row leads if none of its earlier neighbours does."""
    spark, rounds, out = pairs.sparkSession, pairs, []
    while not rounds.isEmpty():
        later = rounds.select(F.col("b").alias("n")).distinct()
        leads = rounds.select(F.col("a").alias("n")).distinct().join(later, "n", "left_anti")
        covered = materialize(rounds.join(leads.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct())
        out.append(covered)
        left = rounds.join(covered.withColumnRenamed("n", "b"), "b", "left_anti").join(covered.withColumnRenamed("n", "a"), "a", "left_anti")
        rounds = materialize(left)
    every = spark.createDataFrame([], "n bigint")
    for covered in out:
        every = every.union(covered)
    return every


def _cut(rows: DataFrame, most: int, size: int) -> int:
    """A number up to which about `size` of rows (n), of numbers up to most, lie; any prefix gives the same clusters."""
    width = max(1, -(-most // 1024))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.floor((F.col("n") - 1) / width).alias("g")).count().collect())  # at most 1,024 rows
    total = 0
    for group, count in counts:
        total += count
        if total >= size:
            return (group + 1) * width
    return most


def leader_clusters(rows: DataFrame, order: str, vec: str, threshold: float = THRESHOLD, first: int = FIRST, taxonomy: dict[str, str] | None = None) -> DataFrame:
    """(order, cluster, leader, rollup): each row's cluster, numbered by their leaders' order from 0 as cluster_<number>, and its leader's order value.

    Rows stand by the column named in order; of rows equal there, either may come first, so it should be unique. Rows with a null order, or a vector that is
    null or holds null or non-finite components, take no part; vectors of different lengths never meet; zero and empty
    vectors lead clusters of their own. rollup is the cluster's entry in the taxonomy, else its default, else empty.
    Equal vectors join the same leader. Other columns are ignored. No rows in, none out.
    """
    spark: SparkSession = rows.sparkSession
    numbered = materialize(positions(units(rows, order, vec).withColumn("dim", F.size("vec")), ["order"], "n"))
    most, left, size, labels = numbered.count(), numbered.drop("order"), first, []
    total = most
    dim = numbered.agg(F.max("dim")).first()[0] or 1
    while total:
        prefix = materialize(left.where(F.col("n") <= _cut(left, most, size)))
        count = prefix.count()
        pairs = materialize(_tiles(prefix, prefix, count, count, threshold, False))
        leads = materialize(prefix.join(_led(pairs), "n", "left_anti"))
        claims = _tiles(leads, left, leads.count(), total, threshold, True, dim).groupBy(F.col("b").alias("n")).agg(F.min("a").alias("lead"))
        decided = materialize(claims.union(leads.select("n", F.col("n").alias("lead"))))
        labels.append(decided)
        rest = materialize(left.join(decided.select("n"), "n", "left_anti"))
        for done in (prefix, pairs, leads):
            drop_scratch(done)
        left, total, size = rest, rest.count(), 2 * size
    label = spark.createDataFrame([], "n bigint, lead bigint")
    for decided in labels:
        label = label.union(decided)
    names = numbered.select("n", "order")
    heads = positions(label.where("n = lead").select("lead"), ["lead"], "number").join(names.select(F.col("n").alias("lead"), F.col("order").alias("leader")), "lead")
    heads = heads.select("lead", "leader", F.concat(F.lit("cluster_"), (F.col("number") - 1).cast("string")).alias("cluster"))
    found = names.join(label, "n").join(materialize(heads), "lead")
    return found.select(F.col("order").alias(order), "cluster", "leader", rollup(F.col("cluster"), taxonomy).alias("rollup"))


def rollup(cluster: Column, taxonomy: dict[str, str] | None) -> Column:
    """A cluster's entry in the taxonomy, else its default, else empty."""
    otherwise = F.lit((taxonomy or {}).get("default", ""))
    if not taxonomy:
        return otherwise
    return F.coalesce(F.create_map(*(F.lit(x) for kv in taxonomy.items() for x in kv))[cluster], otherwise)
