"""Exact top-k by inner product with a vector-approximation file.

Each vector's components are quantised to cells of equal width, a byte each, as wide as its largest component asks. The
file of cells is all that is scanned: the inner product with the cells' centres differs from the true one by at most
half a cell width times the sum of the query's components, so it bounds the score from both sides. Vectors whose upper
bound (the lower bound of a distance) is below the kth largest lower bound are out. Of the others, exact vectors are
read in order of bound: the first FIRST of each query, then those whose bound still reaches its kth exact score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

SCALE, K, EVERY, CELLS, FIRST = 256, 5, 50, 127, 8


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers from -CELLS to CELLS, cell widths, and the largest components."""
    most = np.abs(x).max(axis=1)
    width = np.where(most > 0, most / CELLS, 1.0)
    return np.rint(x / width[:, None]).astype(np.int8), width, most


def bounds(q: np.ndarray, codes):
    """Lower and upper bounds of inner products of a slice of queries with a batch of codes; rounding is allowed for."""
    cells = blocks.unpacked(codes.column("code"), np.int8).astype(np.float32).T
    width, most = codes.column("scale").to_numpy(), codes.column("left").to_numpy()
    reach, asked = np.abs(q).sum(axis=1), q.astype(np.float32)

    def part(at: slice):
        near = (asked[at] @ cells) * width
        slack = reach[at, None] * (width * (0.5 + 1e-6) + most * 1e-6 * (1 + len(cells)))
        return near - slack, near + slack

    return part


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) * q.astype(np.int64)).sum(axis=1)


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by `every`, the k largest integer inner products of floor(scale * x).

    Ties go to the smaller vec_id; fewer candidates give fewer rows. Null vectors, empty ones, and vectors with null or
    non-finite components take no part, nor do rows without an id. Rows that share an id are vectors of their own, and
    queries of their own. Vectors of different lengths are never compared; of any length they are coded whole. Other
    columns are ignored. No rows in, none out.
    """
    v = blocks.valid(rows, id_col, vec_col, nonzero=False)
    v = v.select("row", "vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    return blocks.search(v, every, k, encode, bounds, exact, "bigint", FIRST)
