"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint is eight positional bytes, and the index has a posting list for each (position, byte): 2,048 lists.
Fingerprints that differ in at most three bits differ in at most three bytes, so a pair must share at least five of its
eight lists. In a list, the positional bytes that every two of its fingerprints share are tallied, pairs that reach five
are verified by Hamming distance, and only a spanning forest of the links leaves the task, never all pairs.

A list of more than LIST_MAX fingerprints is not tallied as it is, which would grow with its square. A pair that shares
no shorter list shares five long ones, so long lists are intersected four at a time: fourteen sets of four positions
(the blocks of the Steiner system S(3,4,8)) suffice, as every three positions lie in exactly one block, and its
complement, again a block, is untouched by errors there. An intersection that is still longer is split by the same
design on nibbles, then on pairs of bits; then at most 256 distinct fingerprints can share a list, whatever the data.
Nothing is capped or dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, materialize, slices, small_side

SEED, MAX_BITS, WIDTH, LIST_MAX = 42, 3, 3, 1024
MIN_SHARED = 8 - MAX_BITS


def steiner() -> list[tuple[int, ...]]:
    """Blocks of S(3,4,8): the four-sets of 0..7 whose numbers, as vectors over GF(2), sum to zero."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(raw: bytes | None) -> int:
    """64-bit fingerprint of a text in UTF-8. bytes.lower() changes A-Z alone and bytes.split() splits at 20, 09-0D."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WIDTH:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - WIDTH].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, end[WIDTH - 1 :].tolist())), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp BIGINT, text_key BIGINT): a row per row; a null text is an empty one. text_key is a hash of the text."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in slices(batches, 1):
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], names=["doc_id", "fp", "text_key"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("k"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint, text_key bigint")


def tallied(fps: np.ndarray, least: int = MIN_SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of distinct fingerprints that share at least `least` positional bytes."""
    data = fps.view(np.uint8).reshape(len(fps), 8).T
    tally = np.zeros((len(fps), len(fps)), np.uint8)
    for column in data:
        tally += column[:, None] == column
    i, j = np.nonzero(np.triu(tally >= least, 1))
    return i, j


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints that share a list: tallied, then verified."""
    fps = np.unique(fps)
    i, j = tallied(fps)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
    root, out = list(range(len(fps))), []

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(i[near].tolist(), j[near].tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            out.append((int(fps[a]), int(fps[b])))
    return out


def _forests(batches):
    for b in batches:
        found = [e for v in b.column(0) for e in forest(np.array(v.values, np.int64).view(np.uint64))]
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


#: SQL for the list of each position: position * 256 + byte.
LISTS = [f"{256 * p} + cast(shiftrightunsigned(fp, {8 * p}) & 255 as int)" for p in range(8)]


def _intersections(long: list[int]):
    """Rows (k0, fp, rest) for every block of four positions whose lists are all long: the four bytes, and the other four packed."""
    is_long = np.zeros(2048, bool)
    is_long[long] = True

    def packed(data, positions):
        return sum(data[:, p].astype(np.uint64) << np.uint64(8 * i) for i, p in enumerate(positions))

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            data = fps.view(np.uint8).reshape(len(fps), 8)
            hot = is_long[data + 256 * np.arange(8)]
            for n, block in enumerate(steiner()):
                at = hot[:, list(block)].all(axis=1)
                if at.any():
                    rest = packed(data[at], [p for p in range(8) if p not in block])
                    key = packed(data[at], block) | np.uint64(n << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[at]), pa.array(rest.view(np.int64))], names=["k0", "fp", "rest"])

    return run


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Rows of intersections that are too long, by blocks of nibbles (level 1) or of pairs of bits (2) of the bits that the blocks before did not fix."""
    bits = (8, 4, 2)[level]

    def packed(block):
        return "+".join(f"(((shiftrightunsigned(rest, {bits * p}) & {2**bits - 1})) * {2 ** (bits * i)}L)" for i, p in enumerate(block))

    each = ", ".join(f"struct({n}L * {2 ** (4 * bits)}L + {packed(block)} AS key, {packed([p for p in range(8) if p not in block])} AS rest)" for n, block in enumerate(steiner()))
    keep = [c for c in rows.columns if c != "rest"]
    return rows.withColumn("part", F.explode(F.expr(f"array({each})"))).select(*keep, F.col("part.key").alias(f"k{level}"), F.col("part.rest").alias("rest"))


def _within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spanning edges inside each list of rows."""
    few = rows.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return few.select("fps").mapInArrow(_forests, "a bigint, b bigint")


def links(nodes: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """Spanning edges (a, b) over distinct fingerprints (column fp) whose components are those of all links.

    The lengths of the 2,048 lists are read by the driver; of longer lists, those of intersections, only a table of the
    too long ones is made, each of more than list_max rows.
    """
    nodes = nodes.select("fp")
    listed = nodes.select(F.explode(F.expr(f"array({', '.join(LISTS)})")).alias("list"), "fp")
    long = [r["list"] for r in listed.groupBy("list").count().where(F.col("count") > list_max).select("list").collect()]
    found = _within(listed.where(~F.col("list").isin(long)) if long else listed, ["list"])
    if not long:
        return found.distinct()
    rows = materialize(nodes.mapInArrow(_intersections(long), "k0 bigint, fp bigint, rest bigint"))
    for level in range(3):
        keys = [f"k{i}" for i in range(level + 1)]
        if level:
            rows = materialize(_split(rows, level))
        if level == 2:
            return found.union(_within(rows, keys)).distinct()
        much = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > list_max).select(*keys))
        side = small_side(much)
        found = found.union(_within(rows.join(side, keys, "left_anti"), keys))
        if much.isEmpty():
            return found.distinct()
        rows = rows.join(side, keys, "left_semi")


def _grouped(docs: DataFrame, id_col: str, text_col: str, list_max: int) -> DataFrame:
    """(doc_id, fp, text_key, root, component_id). Labels are joined for fingerprints of several rows or with links alone; the others label themselves."""
    fps = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = materialize(components(links(nodes, list_max)).withColumnRenamed("node", "fp"))
    linked = materialize(nodes.join(roots, "fp").select("fp", "least", "root"))
    of_root = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    known = linked.join(of_root.hint("shuffle_hash"), "root").select("fp", "root", "component_id")
    copies = nodes.where("n > 1").join(roots.select("fp").hint("shuffle_hash"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    labels = small_side(materialize(known.unionByName(copies)), *(["component_id"] if dict(fps.dtypes)["doc_id"] == "string" else []))
    out = fps.join(labels.withColumn("known", F.lit(True)), "fp", "left")
    label = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "fp", "text_key", F.coalesce("root", "fp").alias("root"), label)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_max: int = LIST_MAX) -> DataFrame:
    """(doc_id, fp, component_id): a row per input row; component_id is the smallest doc_id reachable by links.

    Null texts and texts without words have fingerprint 0 and link like others; texts of any length are read whole. Rows
    with a null doc_id take part; their component_id is null only if no row of the component has an id. Repeated rows
    stay repeated. Other columns are ignored. No rows in, none out.
    """
    return _grouped(docs, id_col, text_col, list_max).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_max: int = LIST_MAX) -> DataFrame:
    """One row of docs for each component, with all its columns: the smallest doc_id (nulls last), then the smallest text key."""
    grouped = materialize(_grouped(docs, id_col, text_col, list_max).select("root", "doc_id", "text_key"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"))
    i, k = free_name(docs, "_id"), free_name(docs, "_key")
    kept = materialize(best.select(F.col("m.doc_id").alias(i), F.col("m.text_key").alias(k)).distinct())
    out = docs.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k)), "left_semi")
    repeats = grouped.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    if repeats.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_key") == F.col(k))).isEmpty():
        return out
    return out.dropDuplicates([id_col, text_col])
