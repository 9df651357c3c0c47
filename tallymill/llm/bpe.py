"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-tokenisation uses no regular expression. Every code point gets a class from an array built from Unicode's general
categories; an apostrophe that a contraction may follow gets its own, found by comparing shifted arrays. What starts a
piece then depends on a small finite-state machine. A character's transition is a function on states and composition
of functions is associative, so the states of a whole batch come from a scan: blocks of characters are composed in
parallel, block results are combined by doubling, and each block is replayed from its known entry state. A separator
class between texts resets the machine, so a batch of texts is one array.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, odd_names_aside, quoted, slices

#: Unicode's White_Space; the contractions of the pattern, by length.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

#: Classes of characters; states: what the last character belongs to. In EDGE nothing precedes that could continue.
LETTER, NUMBER, OTHER, SPACE, WHITE, APO1, APO2, SEP = range(8)
EDGE, NEED1, NEED2 = 5, 6, 7
_SEPARATOR = 0x110000
#: Bytes that a codec's cache of pieces may take, each counted with its ids and what Python adds.
CACHE_BYTES, ENTRY_BYTES = 16 << 20, 200


@cache
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return np.append(table, np.uint8(SEP))


def _transitions() -> np.ndarray:
    """next state by (class, state)."""
    t = np.zeros((8, 8), np.uint8)
    for kind in range(8):
        for state in range(8):
            apo = kind in (APO1, APO2)
            if kind == SEP:
                to = EDGE
            elif state == NEED2:
                to = NEED1
            elif state == NEED1:
                to = EDGE
            elif apo and state not in (OTHER, SPACE):
                to = NEED1 if kind == APO1 else NEED2
            else:
                to = OTHER if apo else kind
            t[kind, state] = to
    return t


TRANSITIONS = _transitions()
BLOCK = 256


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The machine's state before each character, by an associative scan of transition functions from EDGE."""
    n = len(kinds)
    blocks = -(-n // BLOCK)
    cols = np.full(blocks * BLOCK, SEP, np.uint8)
    cols[:n] = kinds
    cols = np.ascontiguousarray(cols.reshape(blocks, BLOCK).T)
    flat = TRANSITIONS.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for c in cols:
        f = flat[(c[:, None] << 3) | f]
    step = 1
    while step < blocks:  # f[i] becomes the composition of all blocks up to i
        f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        step *= 2
    state = np.append(np.uint8(EDGE), f[:-1, EDGE])
    out = np.empty_like(cols)
    for j, c in enumerate(cols):
        out[j] = state
        state = flat[(c << 3) | state]
    return out.T.ravel()[:n]


def _refined(codes: np.ndarray) -> np.ndarray:
    kinds = class_table()[codes]
    apo = np.flatnonzero(codes[:-1] == ord("'"))
    one = np.isin(codes[apo + 1], [ord(c) for c in ONE_LETTER])
    third = codes[np.minimum(apo + 2, len(codes) - 1)]
    two = np.zeros(len(apo), bool)
    for a, b in TWO_LETTERS:
        two |= (codes[apo + 1] == ord(a)) & (third == ord(b))
    kinds[apo[two]], kinds[apo[one]] = APO2, APO1
    return kinds


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Mask of the characters at which a piece begins; codes are code points, with a separator at the end of each text."""
    kinds = _refined(codes)
    before = states_before(kinds)
    white = (kinds == SPACE) | (kinds == WHITE)
    was_white = (before == SPACE) | (before == WHITE)
    follows = np.append(kinds[1:], SEP)
    ends_run = (follows != SEP) & (follows != SPACE) & (follows != WHITE)
    plain = np.where((kinds == APO1) | (kinds == APO2), OTHER, kinds)
    joined = (before == SPACE) | (before == NEED1) | (before == NEED2) | (before == plain)
    return np.where(white, ~was_white | ends_run, ~joined) | (kinds == SEP)


def pretokenize(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    joined = "\0".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes[ends] = _SEPARATOR
    at = np.flatnonzero(piece_starts(codes))
    bounds = at.tolist()
    cut = np.searchsorted(at, ends).tolist()
    out, a = [], 0
    for b in cut:
        out.append([joined[i:j] for i, j in zip(bounds[a:b], bounds[a + 1 : b + 1])])
        a = b + 1
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class PairTable:
    """Ranks of pairs of ids whose bytes joined are a token: open addressing in two arrays."""

    EMPTY, SIZE_BITS = np.uint64(2**64 - 1), 19

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys, self.ranks = np.full(1 << self.SIZE_BITS, self.EMPTY), np.full(1 << self.SIZE_BITS, NO_RANK, np.int32)
        key, rank = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        at = self._home(key)
        while len(key):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = key[free]
            won = self.keys[at] == key
            self.ranks[at[won]] = rank[won]
            key, rank, at = key[~won], rank[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _home(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SIZE_BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found != self.EMPTY))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & (len(self.keys) - 1)
            found, k = self.keys[at], key[open_]
            hit = found == k
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (found != self.EMPTY)
            open_, at = open_[more], at[more]
        return out


NO_RANK = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder of one vocabulary; pieces met are cached in CACHE_BYTES, and for one call those of its texts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache, self.cached = ranks, {}, 0
        self.vocab = {r: t for t, r in ranks.items()}
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, packed: in each, the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
        out: list = [r.to_bytes(4, "little") if (r := self.ranks.get(p)) is not None else None for p in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo = np.array([x is None for x in out], bool)
        for least, most in ((0, 8), (8, 16), (16, 32)):
            which = np.flatnonzero(todo & (size > least) & (size <= most))
            if len(which):
                self._merge_short([pieces[i] for i in which], size[which], which, most, out)
        for i in np.flatnonzero(todo & (size > 32)):
            ids = self._merge_long([pieces[i][j : j + 1] for j in range(size[i])])
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _merge_short(self, pieces, size, which, width, out) -> None:
        """All pieces at once: a row of symbols and a row of pair ranks for each; every step merges one pair in each row."""
        col = np.arange(width)
        symbol = np.zeros((len(pieces), width), np.int64)
        symbol[col < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NO_RANK, np.int32)
        paired = col[:-1] < size[:, None] - 1
        rank[:, :-1][paired] = self.pairs(symbol[:, :-1][paired], symbol[:, 1:][paired])
        while len(which):
            at = rank.argmin(axis=1)
            row = np.arange(len(which))
            best = rank[row, at]
            done = best == NO_RANK
            if done.any():
                packed = symbol[done].astype("<u4").tobytes()
                for j, i, n in zip(range(0, len(packed), 4 * width), which[done].tolist(), size[done].tolist()):
                    out[i] = packed[j : j + 4 * n]
                go = ~done
                symbol, rank, size, which, at, best = symbol[go], rank[go], size[go], which[go], at[go], best[go]
                row = np.arange(len(which))
            if not len(which):
                break
            later = col[:-1] > at[:, None]
            symbol[:, :-1] = np.where(later, symbol[:, 1:], symbol[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            symbol[row, at] = best
            size = size - 1
            rank[row, at] = NO_RANK
            for first in (at, at - 1):
                m = np.flatnonzero((first >= 0) & (first + 1 < size))
                a = first[m]
                rank[m, a] = self.pairs(symbol[m, a], symbol[m, a + 1])

    def _merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same by a heap over a linked list, for pieces of any length."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = pretokenize(texts)
        new = set(chain.from_iterable(lists))
        new = [p for p in new if p not in self.cache]
        ids = self.merge([p.encode() for p in new])
        size = ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, ids))
        if self.cached + size > CACHE_BYTES and self.cache:
            again = set(chain.from_iterable(lists)) & self.cache.keys()
            new, ids = [*new, *again], [*ids, *map(self.cache.__getitem__, again)]
            size += ENTRY_BYTES * len(again)
            self.cache, self.cached = {}, 0
        self.cache.update(zip(new, ids))
        self.cached += size
        get, out = self.cache.__getitem__, []
        for i, pieces in enumerate(lists):
            out.append(np.frombuffer(b"".join(map(get, pieces)), "<u4"))
            lists[i] = None
        return out

    def tokens(self, ids: np.ndarray) -> list[bytes]:
        return [self.vocab[i] for i in ids.tolist()]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens' starts, and the end."""
        return np.concatenate([[0], np.cumsum([len(t) for t in self.tokens(ids)], dtype=np.int64)]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens(ids))


@cache
def codec(path: str) -> Codec:
    return Codec(load_ranks(path))


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


@odd_names_aside
def encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """docs with columns ids ARRAY<INT> and offsets ARRAY<BIGINT> (byte offsets of the tokens and the text's end).

    A null text is an empty one: no ids. Columns of these two names in docs are replaced, all others stay, whatever
    their names. A text of any length is encoded whole, one of more than 1 MB by itself. ranks_path is a file that every
    executor has.
    """
    keep = [c for c in docs.columns if c not in ("ids", "offsets")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>", "offsets array<bigint>"])

    def run(batches):
        c = codec(ranks_path)
        for b in slices(batches, len(keep)):
            ids = c.encode([x.decode() for x in b.column(len(keep)).to_pylist()])
            cols = [pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, "ids", "offsets"])

    return docs.select(*map(quoted, keep), _raw(text_col).alias(free_name(docs, "_raw"))).mapInArrow(run, schema)


@odd_names_aside
def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded BINARY: the bytes its ids stand for; null ids give no bytes."""
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep] + ["decoded binary"])

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            got = [c.decode(np.array(x or [], np.uint32)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*keep, "decoded"])

    return encoded.select(*map(quoted, keep)).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) a row per row: encodes, decodes the ids, and hashes both.

    The ids are hashed where they are made, so that arrays of them need not leave the task. A null or empty text has no
    tokens and the hashes of no bytes. Ids may be null or repeat; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(ranks_path)
        for b in slices(batches, 1):
            ids = c.encode([x.decode() for x in b.column(1).to_pylist()])
            cols = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, _raw(text_col).alias(free_name(docs, "_raw"))).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
