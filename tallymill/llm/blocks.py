"""Top-k search of a stated query set against all vectors: blocks of codes are scanned, exact vectors are read for survivors alone.

What is copied to meet in a task is small: a vector's code (a few bytes a component or less, and a few scalars) once for
each block of queries, and a query once for each block of codes. A scan puts out the vectors that a block can't exclude,
with bounds. Bounds of all blocks together exclude more. The rest are read exactly: first each query's most promising,
whose kth exact score then decides which others are read at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Codes and queries in a block, queries scanned at a time, bytes of codes coded at a time.
VECTORS, QUERIES, CHUNK, CODED = 65536, 512, 64, 4096
CODE = "row bigint, vec_id bigint, dim int, code binary, scale double, left double"
BOUNDS = "query bigint, row bigint, low double, high double"


def valid(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(row, vec_id, vec ARRAY<DOUBLE>) of the rows that take part; row is a number of its own for each, so rows that share an id stay apart."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad)
    if nonzero:
        ok &= F.exists(vec, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull()).where(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), vec.alias("vec"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def unpacked(column, kind) -> np.ndarray:
    """Rows of an Arrow column of binary values of one length."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(v.to_pylist()), kind).reshape(len(v), -1)


def coded(vectors: DataFrame, encode) -> DataFrame:
    """The approximation file: a code and two scalars for each vector; encode(matrix) gives packed rows, scales and a second scalar."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CODED):
                part = b.slice(at, CODED)
                dims = np.diff(part.column(2).offsets.to_numpy())
                for dim in np.unique(dims).tolist():
                    take = pa.array(np.flatnonzero(dims == dim))
                    rows, ids, vec = (c.take(take) for c in part.columns)
                    codes, scale, left = encode(matrix(vec))
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                    cols = [rows, ids, pa.array(np.full(len(take), dim, np.int32)), packed, pa.array(scale), pa.array(left)]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "vec_id", "dim", "code", "scale", "left"])

    return vectors.mapInArrow(run, CODE)


def scan(queries: DataFrame, codes: DataFrame, n_queries: int, n_codes: int, bounds, k: int) -> DataFrame:
    """(query, row, low, high) of the pairs that no block excludes: high reaches the kth largest low of the query in the block.

    bounds(query matrix, code batch) gives functions for lows and highs of a slice of queries. Blocks meet by an equi-join.
    """
    salts, parts = max(1, -(-n_codes // VECTORS)), max(1, -(-n_queries // QUERIES))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(m)).cast("int")
    left = queries.select("row", "vec", F.size("vec").alias("dim"), block(parts, 1).alias("q"), numbers(salts).alias("v"))
    right = codes.select("*", block(salts, 2).alias("v"), numbers(parts).alias("q"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(a) and len(b):
            asked, rows, q = a.column("row").to_numpy(), b.column("row").to_numpy(), matrix(a.column("vec"))
            low_high = bounds(q, b)
            for at in range(0, len(q), CHUNK):
                low, high = low_high(slice(at, at + CHUNK))
                own = asked[at : at + CHUNK, None] == rows[None, :]
                low[own] = high[own] = -np.inf
                kth = np.partition(low, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(low), -np.inf)
                i, j = np.nonzero((high >= kth[:, None]) & (high > -np.inf))
                for column, x in zip(out, (asked[at + i], rows[j], low[i, j].astype(float), high[i, j].astype(float))):
                    column.append(x)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(c.astype(t.to_pandas_dtype()), t) for n, c, t in zip(("query", "row", "low", "high"), cols, types)})

    keys = ["dim", "q", "v"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, BOUNDS)


def read(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, exact, score_type: str) -> DataFrame:
    """(query, query_id, row, vec_id, score) of pairs (query, row): the exact vectors are fetched by row number."""
    a = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vec").alias("qv"))
    both = pairs.select("query", "row").join(vectors.select("row", "vec_id", "vec"), "row").join(a, "query")
    value = pa.int64() if score_type == "bigint" else pa.float64()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CODED):
                part = b.slice(at, CODED)
                dims = np.diff(part.column(4).offsets.to_numpy())
                for dim in np.unique(dims).tolist():
                    take = pa.array(np.flatnonzero(dims == dim))
                    query, query_id, row, vec_id, x, q = (c.take(take) for c in part.columns)
                    cols = [query, query_id, row, vec_id, pa.array(exact(matrix(x), matrix(q)), value)]
                    yield pa.RecordBatch.from_arrays(cols, names=["query", "query_id", "row", "vec_id", "score"])

    return both.select("query", "query_id", "row", "vec_id", "vec", "qv").mapInArrow(run, f"query bigint, query_id bigint, row bigint, vec_id bigint, score {score_type}")


def search(vectors: DataFrame, every: int, k: int, encode, bounds, exact, score_type: str, first: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors of valid(): queries are ids divisible by `every`, candidates all rows but the query's own, of as many components.

    first: how many of a query's pairs are read before the kth exact score decides on the others.
    """
    vectors = materialize(vectors)
    codes = materialize(coded(vectors, encode))
    queries = vectors.where(F.col("vec_id") % every == 0)
    found = materialize(scan(queries, codes, queries.count(), vectors.count(), bounds, k))
    best = Window.partitionBy("query").orderBy(F.col("high").desc(), "row")
    lows = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc(), "row"))).where(F.col("at") == k)
    left = found.join(lows.select("query", F.col("low").alias("least")), "query", "left").where("least is null or high >= least")
    left = materialize(left.withColumn("at", F.row_number().over(best)).select("query", "row", "high", "at"))
    top = materialize(read(left.where(F.col("at") <= first), vectors, queries, exact, score_type))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    kth = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    more = left.where(F.col("at") > first).join(kth, "query").where("high >= least")
    every_one = top.unionByName(read(more, vectors, queries, exact, score_type))
    ranked = every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
