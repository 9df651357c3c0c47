"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Index. Documents are cut into segments where they lie, a few megabytes of text each, and a segment's inverted lists are
made in one task: (segment, term, documents, counts), documents standing in order of id. Postings are never shuffled to
build it, and it serves any query set.

Search. Lists of the terms that are asked for meet their terms' weights by an equi-join.
1. Term at a time: short lists (terms in at most SHORT of the documents) are summed into accumulators, one written row
   (segment, item, documents, sums). The kth largest sum of an item over all segments is a floor for its results, as the
   other terms only add to a score.
2. Document at a time: in each segment an item's accumulators are one more iterator beside its long lists, bounded by
   its largest sum. The documents are walked in windows. A window is skipped if the bounds of its iterators don't add up
   to the kth score so far. In others, iterators that can't reach it together are only looked up, for documents of
   the others that still can.

At most k results of a segment and an item leave a task, the k best of each item are ranked. The result is exact.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.scoring import positions
from .common import materialize, quoted, slices, small_side

#: A term, of text in which only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, SHORT, SEGMENT_BYTES, WINDOW, ITEMS = 20, 1 / 64, 8 << 20, 1024, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text, A-Z lower-cased and what belongs to no term made a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def inverted(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, ends of their lists, documents, counts, and the number of terms of each document."""
    found = [raw.translate(_BYTES).split() if raw else [] for raw in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(chain.from_iterable(found), pa.binary()).dictionary_encode()
    pair = coded.indices.to_numpy().astype(np.int64) * max(1, len(found)) + np.repeat(np.arange(len(found)), sizes)
    pair, counts = np.unique(pair, return_counts=True)
    term, doc = np.divmod(pair, max(1, len(found)))
    ends = np.searchsorted(term, np.arange(len(coded.dictionary)), side="right")
    return coded.dictionary, ends, doc, counts, sizes


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index: (segment, term, size, docs, counts, ids).

    A row with a term holds its list: places of documents in the segment, and how often each has the term. A segment's
    row without a term holds the id of each document and, as counts, its number of terms; size is the rows' length.
    Documents without terms, null texts among them, are left out; ids may be null or repeat. Texts of any length are read whole.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, 1, segment_bytes):
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_end"))
            terms, ends, doc, counts, sizes = inverted(b.column(1).to_pylist())
            some = np.flatnonzero(sizes)
            if len(some):
                place = np.cumsum(sizes > 0) - 1
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place[doc], counts)]
                ids = b.column(0).take(pa.array(some))
                n = len(terms)
                text = terms.cast(pa.string(), safe=False)
                of = pa.array(np.full(n, number), pa.int64())
                yield pa.RecordBatch.from_arrays([of, text, pa.array(np.diff(offsets)), *lists, pa.nulls(n, pa.list_(ids.type))], names=names)
                whole = [pa.array([number]), pa.nulls(1, pa.string()), pa.array([len(some)], pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]
                tail = [pa.array([sizes[some].astype(np.int32)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids)]
                yield pa.RecordBatch.from_arrays(whole + tail, names=names)
            number += 1

    names = ["segment", "term", "size", "docs", "counts", "ids"]
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("raw"))
    return materialize(rows.mapInArrow(run, f"segment bigint, term string, size int, docs array<int>, counts array<int>, ids array<{kind.simpleString()}>"))


def norms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with so many terms among n documents of total terms."""
    return 75 + (25 * sizes.astype(np.int64) * n) // total


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score of documents with so many of it."""
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Iterator:
    """Documents in order with what each would add, cut at the ends of windows; best holds each window's largest."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray, edges: np.ndarray):
        self.docs, self.adds, self.cut = docs, adds, np.searchsorted(docs, edges)
        some = self.cut[:-1] < self.cut[1:]
        self.best = np.zeros(len(some), np.int64)
        if some.any():
            self.best[some] = np.maximum.reduceat(adds, self.cut[:-1][some])

    def window(self, w: int) -> slice:
        return slice(self.cut[w], self.cut[w + 1])


def best_documents(lists: list[tuple[int, Iterator]], edges: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best, at least floor and 1: (weight, iterator) are walked window by window. Of equal scores the first documents stay."""
    weights = np.array([w for w, _ in lists], np.int64)
    bound = weights[:, None] * np.array([it.best for _, it in lists])
    least = max(floor, 1)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in np.flatnonzero(bound.sum(axis=0) >= least).tolist():
        order = np.argsort(bound[:, w], kind="stable")
        reach = np.cumsum(bound[order, w])
        if reach[-1] < least:
            continue
        first = int(np.searchsorted(reach, least))  # iterators before it can't reach the least score together
        sums = np.zeros(edges[w + 1] - edges[w], np.int64)
        for i in order[first:].tolist():
            it = lists[i][1]
            at = it.window(w)
            sums[it.docs[at] - edges[w]] += weights[i] * it.adds[at]
        left = int(reach[first - 1]) if first else 0
        near = np.flatnonzero((sums > 0) & (sums + left >= least))
        for i in order[:first][::-1].tolist():
            if not len(near):
                break
            it = lists[i][1]
            at = it.window(w)
            if at.start < at.stop:
                known = it.docs[at] - edges[w]
                spot = np.minimum(np.searchsorted(known, near), len(known) - 1)
                hit = known[spot] == near
                sums[near[hit]] += weights[i] * it.adds[at][spot[hit]]
            left -= int(bound[i, w])
            near = near[sums[near] + left >= least]
        if len(near):
            docs, scores = np.concatenate([docs, near + edges[w]]), np.concatenate([scores, sums[near]])
            if len(docs) > k:
                keep = np.sort(np.argsort(-scores, kind="stable")[:k])  # places stay in order, so ties stay with the first
                docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                least = max(least, int(scores.min()))
    return docs, scores


def _lists(t: pa.Table, n: int, total: int):
    """The segment's ids and edges of windows, and for each term row its documents, impacts and entries."""
    head = t.filter(pc.is_null(t.column("term"))).slice(0, 1)
    if not len(head):
        return None, None, None, []
    m = norms(head.column("counts").combine_chunks().flatten().to_numpy(), n, total)
    edges = np.append(np.arange(0, len(m), WINDOW), len(m))
    rows = t.filter(pc.is_valid(t.column("term"))).combine_chunks()
    flat = [rows.column(c).combine_chunks() if len(rows) else None for c in ("docs", "counts", "entries")]
    out = []
    for r in range(len(rows)):
        docs, counts = (c[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat[:2])
        out.append((docs, impacts(counts, m[docs]), flat[2][r].values))
    return head.column("ids").combine_chunks().flatten(), m, edges, out


def _summed(n: int, total: int):
    def run(t: pa.Table) -> pa.Table:
        ids, m, _, lists = _lists(t, n, total)
        docs_of, adds_of = {}, {}
        for docs, adds, entries in lists:
            for item, weight in zip(entries.field("item").to_pylist(), entries.field("weight").to_pylist()):
                docs_of.setdefault(item, []).append(docs)
                adds_of.setdefault(item, []).append(weight * adds)
        out = []
        for item, docs in docs_of.items():
            sums = np.zeros(len(m), np.int64)
            for d, a in zip(docs, adds_of[item]):
                sums[d] += a
            some = np.flatnonzero(sums)
            if len(some):
                out.append((item, some, sums[some]))
        part = {c: t.column(c)[0].as_py() for c in ("segment", "block")}
        kinds = {"docs": pa.list_(pa.int32()), "sums": pa.list_(pa.int64())}
        cols = {c: pa.array([part[c]] * len(out), t.schema.field(c).type) for c in part}
        cols |= {"item": pa.array([o[0] for o in out], pa.int64()), "docs": pa.array([o[1].astype(np.int32) for o in out], kinds["docs"]), "sums": pa.array([o[2] for o in out], kinds["sums"])}
        return pa.table(cols)

    return run


def _searched(n: int, total: int, k: int, id_type: pa.DataType):
    def run(t: pa.Table, sums: pa.Table) -> pa.Table:
        ids, m, edges, lists = _lists(t, n, total)
        of, floors = {}, {}
        for docs, adds, entries in lists:
            it = Iterator(docs, adds, edges)
            for item, weight, floor in zip(*(entries.field(c).to_pylist() for c in ("item", "weight", "floor"))):
                of.setdefault(item, []).append((weight, it))
                floors[item] = floor
        sums = sums.combine_chunks()
        for item, docs, adds, floor in zip(*(sums.column(c) for c in ("item", "docs", "sums", "floor"))):
            it = Iterator(docs.values.to_numpy().astype(np.int64), adds.values.to_numpy(), edges)
            of.setdefault(item.as_py(), []).append((1, it))
            floors[item.as_py()] = floor.as_py()
        items, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, its in of.items():
            docs, score = best_documents(its, edges, floors[item] or 0, k)
            items += [item] * len(docs)
            places.append(docs)
            scores.append(score)
        found = pa.nulls(0, id_type) if ids is None else ids.take(pa.array(np.concatenate(places)))
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": found.cast(id_type), "score": pa.array(np.concatenate(scores))})

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, q): how often each item (item, text) has each of its terms."""
    low = F.translate("text", UPPER, LOWER)
    return items.select("item", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("q"))


def search(lists: DataFrame, items: DataFrame, k: int = K, short: float = SHORT, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k documents of an index() with the highest scores above 0.

    Equal scores go by ascending doc_id, null ids last. Each row of items is a query of its own, also where ids are null
    or repeat; a null text, or one without terms, gives no rows. short is the share of the documents up to which a
    term's list counts as short; it changes the work and never the result. Items are searched in blocks of ITEMS. An
    empty index or no items give no rows.
    """
    id_type = lists.schema["ids"].dataType.elementType
    whole = lists.where("term is null")
    facts = whole.agg(F.sum("size").alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    n, total = facts["n"] or 0, facts["total"] or 1
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(item_col)).alias("item_id"), F.col(quoted(text_col)).alias("text"))
    numbered = positions(materialize(asked), ["row"], "item").withColumn("block", F.floor(F.col("item") / ITEMS).cast("int"))
    numbered = materialize(numbered.drop("row"))
    last = numbered.agg(F.max("block")).first()[0] or 0
    terms = materialize(item_terms(numbered))
    found = lists.where("term is not null").join(small_side(materialize(terms.select("term").distinct()), "term"), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = materialize(terms.join(df, "term").join(numbered.select("item", "block"), "item").select("item", "block", "term", "df", (F.col("q") * weight).alias("weight")).where("weight > 0"))
    def met(kind, *more):
        """Lists of a kind with the entries of the items that ask for them, and every segment's own row, by block of items."""
        entry = weighed if not more else weighed.join(more[0], "item", "left")
        entry = entry.where(kind).groupBy("term", "block").agg(F.collect_list(F.struct("item", "weight", *(["floor"] if more else []))).alias("entries"))
        side = small_side(materialize(entry.withColumnRenamed("term", "_term")), "entries")
        some = lists.join(side, F.col("term") == F.col("_term"))
        own = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
        columns = ["segment", "block", "term", "docs", "counts", "ids"]
        return some.select(*columns, "entries").unionByName(own.select(*columns), allowMissingColumns=True)

    limit = int(n * short)
    by = ["segment", "block"]
    sums = materialize(met(F.col("df") <= limit).groupBy(*by).applyInArrow(_summed(n, total), "segment bigint, block int, item bigint, docs array<int>, sums array<bigint>"))
    high = sums.select("item", F.explode(F.slice(F.sort_array("sums", asc=False), 1, k)).alias("sum"))
    ranked = high.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.col("sum").desc()))).where(F.col("at") <= k)
    floors = materialize(ranked.where(F.col("at") == k).select("item", F.col("sum").alias("floor")))
    accumulators = sums.join(floors, "item", "left")
    kind = id_type.simpleString()
    best = met(F.col("df") > limit, floors).groupBy(*by).cogroup(accumulators.groupBy(*by)).applyInArrow(_searched(n, total, k, to_arrow_type(id_type)), f"item bigint, doc_id {kind}, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
