"""Exact removal of repeated word windows by recompression.

Each document's words are symbols. A round first names maximal runs of one symbol, then names every adjacent pair whose
first symbol falls in the left and whose second in the right half of the alphabet (a bit of the symbol's hash, new in
each round). A name is a 64-bit hash of what it stands for, so names are global without a lookup and equal substrings
get equal names but near their ends. How near is tracked exactly: with each symbol goes its footprint, the words on
which its being there depends. A symbol whose footprint lies within a window appears in every other occurrence of it.

Every window of 35 words is represented by one such symbol: of the highest round that has any, the one of least key, a
key being a hash of the footprint's words. Equal windows have equal representatives (single words serve at last), so
windows that repeat meet on a shared key. Neighbouring windows with one representative form a segment, and segments are
the rows that Spark shuffles: about one for 13 words. Of segments that share a key, those whose whole content is shared
are settled at once; for the others, one of each content is expanded and its windows are compared by
128-bit hashes. Both halves of a hash rest on halves of their own of each word's 128-bit hash, a segment's key and
content likewise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, free_name, materialize, odd_names_aside, quoted, slices, small_side

WINDOW, ROUNDS = 35, 3
_U = np.uint64
#: Odd multipliers for mixing and for the two polynomial hashes.
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)


def _mix(a, b):
    h = a * _M1 + (b ^ (b >> _U(29))) * _M2
    h = (h ^ (h >> _U(32))) * _M3
    return h ^ (h >> _U(29))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int):
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


class Hasher:
    """Hashes of word ranges [lo, hi) of one sequence, in constant time each."""

    def __init__(self, words: np.ndarray, which: int):
        up, self.down = _POWERS[which].get(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * up[: len(words)], dtype=_U)])

    def __call__(self, lo, hi):
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def symbols(words: np.ndarray, sep: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Footprints (first, last word) of the symbols of each round, separators left out; round 0 has the words."""
    at = np.arange(len(words))
    name, fl, fr, out = words, at, at, [(at[~sep], at[~sep])]
    for r in range(1, rounds + 1):
        first = np.concatenate([[True], (name[1:] != name[:-1]) | sep[1:]])
        i = np.flatnonzero(first)
        k = np.diff(i, append=len(name))
        own = sep[i]
        fl, fr = np.where(own, fl[i], fl[np.maximum(i - 1, 0)]), np.where(own, fr[i], fr[np.minimum(i + k, len(name) - 1)])
        name, sep = np.where(k > 1, _mix(name[i], k.astype(_U)), name[i]), own
        right = (_mix(name, np.full(1, r, _U)) >> _U(63)).astype(bool) & ~sep
        left = ~right & ~sep
        pair = np.concatenate([left[:-1] & right[1:], [False]])
        keep = np.concatenate([[True], ~pair[:-1]])
        after, before = np.roll(fr, -1), np.roll(fl, 1)
        name = np.where(pair, _mix(name, np.roll(name, -1) + _M1), name)[keep]
        fl, fr, sep = np.where(right, before, fl)[keep], np.where(left, after, fr)[keep], sep[keep]
        out.append((fl[~sep], fr[~sep]))
    return out


def _range_min(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each nonempty range lo..hi (inclusive), the first place of the least key in it."""
    tables, span = [np.arange(len(key))], 1
    most = int((hi - lo).max()) + 1
    while 2 * span <= most:
        t = tables[-1]
        a, b = t[:-span], t[span:]
        tables.append(np.where(key[b] < key[a], b, a))
        span *= 2
    level = np.zeros(most + 1, np.int64)
    for n in range(2, most + 1):
        level[n] = level[n // 2] + 1
    at, out = level[hi - lo + 1], np.empty(len(lo), np.int64)
    for j, t in enumerate(tables):
        m = np.flatnonzero(at == j)
        a, b = t[lo[m]], t[hi[m] + 1 - (1 << j)]
        out[m] = np.where(key[b] < key[a], b, a)
    return out


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with a separator before, between and after, in two rows (the halves of 128 bits); the separators' mask; each text's first place and number of words."""
    lists = [x.split() if x else [] for x in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    start = np.cumsum(n + 1) - n
    total = int(n.sum()) + len(n) + 1
    words, sep = np.zeros((2, total), _U), np.zeros(total, bool)
    sep[0] = sep[start + n] = True
    words[:, ~sep] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for ws in lists for w in ws]), _U).reshape(-1, 2).T
    return words, sep, start, n


def segments(words: np.ndarray, sep: np.ndarray, start: np.ndarray, n: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """Segments of windows with one representative: (text no., key, content signature, first window, last window), windows by first word in the text."""
    doc = np.flatnonzero(n >= window)
    empty = np.zeros(0, np.int64)
    if not len(doc):
        return empty, empty.astype(_U), empty.astype(_U), empty, empty
    many = n[doc] - window + 1
    of = np.repeat(doc, many)
    p = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[of]
    keys, content = Hasher(words[0], 0), Hasher(words[1], 1)
    rep, key_of = np.full(len(p), -1, np.int64), np.zeros(len(p), _U)
    open_ = np.arange(len(p))
    for level, (fl, fr) in reversed(list(enumerate(symbols(words[0], sep, rounds)))):
        key = _mix(keys(fl, fr + 1), ((fr - fl) * 8 + level).astype(_U))
        before = np.concatenate([[0], np.cumsum(np.bincount(fl, minlength=words.shape[1]))])  # symbols whose footprint begins before a word
        until = np.cumsum(np.bincount(fr, minlength=words.shape[1]))
        lo, hi = before[p[open_]], until[p[open_] + window - 1] - 1
        has = lo <= hi
        if has.any():
            best = _range_min(key, lo[has], hi[has])
            at = open_[has]
            rep[at], key_of[at] = best * 8 + level, key[best]
            open_ = open_[~has]
        if not len(open_):
            break
    new = np.concatenate([[True], (rep[1:] != rep[:-1]) | (of[1:] != of[:-1])])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(p)) - 1
    sig = _mix(content(p[i], p[j] + window), key_of[i] + (p[j] - p[i]).astype(_U))
    return of[i], key_of[i], sig, p[i] - start[of[i]], p[j] - start[of[i]]


def _segment_rows(window: int):
    def run(batches):
        for b in slices(batches, 2):
            of, key, sig, lo, hi = segments(*split_words(b.column(2).to_pylist()), window)
            who = pa.array(of)
            cols = [b.column(0).take(who), b.column(1).take(who), pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "tk", "key", "sig", "lo", "hi"])

    return run


def _window_rows(window: int):
    """Rows id, tk, text, segments (lo, hi, many): a row for each window, with two hashes of its words."""

    def run(batches):
        for b in slices(batches, 2):
            words, _, start, _ = split_words(b.column(2).to_pylist())
            halves = [Hasher(words[k], k) for k in (0, 1)]
            seg = b.column(3)
            flat, count = seg.flatten(), np.diff(seg.offsets.to_numpy())
            lo, hi, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            doc = np.repeat(np.arange(b.num_rows), count)
            size = (hi - lo + 1).astype(np.int64)
            p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
            doc, many = np.repeat(doc, size), np.repeat(many, size)
            g = p + start[doc]
            who = pa.array(doc)
            cols = [b.column(0).take(who), b.column(1).take(who), *(pa.array(h(g, g + window).view(np.int64)) for h in halves), pa.array(many), pa.array(p.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "tk", "h1", "h2", "many", "p"])

    return run


def covered(n: int, ranges: bytes | None) -> np.ndarray:
    """Mask of the words in ranges first..end - 1 (pairs of 32-bit integers)."""
    out = np.zeros(n, bool)
    for first, end in np.frombuffer(ranges or b"", np.int32).reshape(-1, 2).tolist():
        out[first:end] = True
    return out


def merged(lo: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges lo..end - 1 joined where they meet or overlap, packed."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return np.stack([lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], 1).astype(np.int32).tobytes()


def _pack(window: int):
    def run(batches):
        for b in batches:
            v = b.column(2)
            lo, hi = (v.flatten().field(k).to_numpy() for k in range(2))
            cut = v.offsets.to_numpy() - v.offsets[0].as_py()
            packed = pa.array([merged(lo[i:j], hi[i:j] + window) for i, j in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], names=["id", "tk", "ranges"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tk, ranges): for each text that has repeated windows, the ranges of words they cover, packed as 32-bit pairs; materialised.

    tk is xxhash64 of the text; with it rows that repeat an id are told apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).cast("binary").alias("t"))
    segs = materialize(rows.mapInArrow(_segment_rows(window), f"id {kind}, tk bigint, key bigint, sig bigint, lo int, hi int"))
    every = segs
    shared = materialize(segs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    segs = materialize(segs.join(shared.hint("shuffle_hash"), "key", "left_semi"))  # a written side: the join may split its hot keys
    same = segs.groupBy("key", "sig").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "tk", "lo", "hi"), F.struct("tk", "lo")).alias("one"))
    same = materialize(same)
    equal = materialize(same.where("n > 1").select("key", "sig"))
    whole = segs.join(equal.hint("shuffle_hash"), ["key", "sig"], "left_semi").select("id", "tk", "lo", "hi")
    mixed = materialize(same.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    probe = same.join(mixed.hint("shuffle_hash"), "key", "left_semi").select("one.*", (F.col("n") > 1).alias("many"))
    probe = materialize(probe.groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "hi", "many")).alias("segs")))
    of = small_side(probe.select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), "segs"), "segs")
    texts = rows.join(of, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).select("id", "tk", "t", "segs")
    wins = materialize(texts.mapInArrow(_window_rows(window), f"id {kind}, tk bigint, h1 bigint, h2 bigint, many boolean, p int"))
    again = materialize(wins.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("many").alias("any_many")).where("n > 1 or any_many").select("h1", "h2"))
    single = wins.where("not many").join(again.hint("shuffle_hash"), ["h1", "h2"], "left_semi").select("id", "tk", F.col("p").alias("lo"), F.col("p").alias("hi"))
    per_doc = whole.union(single).groupBy("id", "tk").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    found = materialize(per_doc.mapInArrow(_pack(window), f"id {kind}, tk bigint, ranges binary"))
    for used in (every, shared, segs, same, equal, mixed, probe, wins, again):
        drop_scratch(used)
    return found


def with_repeats(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with a new column `out` (the ranges of repeats; null: none), joined without shuffling texts when the ranges are few."""
    found = repeats(docs, id_col, text_col, window)
    i, t = free_name(docs, "_id"), free_name(docs, "_tk")
    side = small_side(found, "ranges").select(F.col("id").alias(i), F.col("tk").alias(t), F.col("ranges").alias(out))
    return docs.join(side, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(t)), "left").drop(i, t)


def digest(raw: bytes | None, ranges: bytes | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = raw.split() if raw else []
    gone = covered(len(words), ranges)
    n = int(gone.sum())
    return len(words), n, b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n else words)


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row per row of docs.

    A null text has no words; a text of fewer than `window` words keeps them all, one of any length is read whole. Rows
    that repeat a text repeat its windows, so both lose them. Ids may be null or repeat. No rows in, none out. Other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 1):
            got = [digest(t, r) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = with_repeats(narrow, "ranges", "id", "t", window).select("id", F.col("t").cast("binary"), "ranges")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


@odd_names_aside
def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated windows removed from the texts; all columns and rows stay, texts without repeats stay as they are, null texts too.

    Kept words are joined by one space in texts that lose any. Other columns may have any names.
    """
    names, text_at, ranges = docs.columns, docs.columns.index(text_col), free_name(docs, "_ranges")

    def run(batches):
        for b in slices(batches, text_at):
            texts = b.column(text_at).cast(pa.binary()).to_pylist()
            texts = [t if r is None else digest(t, r)[2] for t, r in zip(texts, b.column(len(names)).to_pylist())]
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return with_repeats(docs, ranges, id_col, text_col, window).select(*map(quoted, names), ranges).mapInArrow(run, docs.schema)
