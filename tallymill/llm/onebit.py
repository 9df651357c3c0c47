"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are rotated into eight times as many components by a random matrix with orthonormal columns and only the signs
are kept, packed to bits. With a code s go two correction scalars, made when it is encoded: the factor that makes the
estimate <q, s> exact for the vector itself, and the length of what is left over. The estimate's error is the query's
component along that leftover, so it seldom goes beyond EPSILON standard deviations of a random direction's. Only bits
and scalars are scanned. Vectors whose upper bound reaches the kth largest estimate are chosen for reranking, and their
exact vectors are read: the first FIRST of each query, then those whose bound still reaches its kth exact score.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from . import blocks

K, EVERY, WIDEN, EPSILON, FIRST, SEED, UNPACKED = 20, 20, 8, 1.9, 40, 7, 8192


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random dim x bits matrix with orthonormal rows; bits is a multiple of 8."""
    bits = -(-WIDEN * dim // 8) * 8
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0].T


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, estimate factors and leftover lengths of nonzero vectors."""
    turn = rotation(x.shape[1])
    y = x @ turn
    back = np.where(y >= 0, 1.0, -1.0) @ turn.T
    square = (x * x).sum(axis=1)
    factor = square / np.maximum((x * back).sum(axis=1), 1e-300)
    left = np.sqrt(np.maximum(factor**2 * (back * back).sum(axis=1) - square, 0.0))
    return np.packbits(y >= 0, axis=1), factor, left


def bounds(q: np.ndarray, codes):
    """Estimates and upper bounds of inner products of a slice of queries with a batch of codes."""
    bits = blocks.unpacked(codes.column("code"), np.uint8)
    factor, left = (codes.column(c).to_numpy().astype(np.float32) for c in ("scale", "left"))
    turned = (q @ rotation(q.shape[1])).astype(np.float32)
    reach = (EPSILON * np.linalg.norm(q, axis=1) / np.sqrt(max(q.shape[1] - 1, 1))).astype(np.float32)

    def part(at: slice):
        near = np.empty((len(turned[at]), len(bits)), np.float32)
        for i in range(0, len(bits), UNPACKED):
            signs = np.unpackbits(bits[i : i + UNPACKED], axis=1).astype(np.float32) * 2 - 1
            near[:, i : i + UNPACKED] = turned[at] @ signs.T
        near *= factor
        return near, near + reach[at, None] * left

    return part


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on."""
    return np.cumsum(x * q, axis=1)[:, -1]


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by `every`, its k nearest by inner product as found, exact scores.

    Ties go to the smaller vec_id; fewer candidates give fewer rows. Null, zero and empty vectors, and vectors with null
    or non-finite components take no part, nor do rows without an id. Rows that share an id are vectors of their own, and
    queries of their own. Vectors of different lengths are never compared; of any length they are coded whole. Other
    columns are ignored. No rows in, none out.
    """
    return blocks.search(blocks.valid(rows, id_col, vec_col, nonzero=True), every, k, encode, bounds, exact, "double", FIRST)
