"""Concept search: which tables, columns and cards speak of a concept, in one pass over their texts by a multi-pattern automaton."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a hit carries: the kind of thing that it is in, its role there, and its keys.
HIT = ("kind", "role", "table_key", "ddl", "legacy")
READ_ROWS = 256


def blobs(rows: DataFrame, kind: str, role: str = "", table_key: str | None = None, ddl: str | None = None, legacy: str | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """(kind, role, table_key, ddl, legacy, text): rows as things that are searched; text joins the named keys and further columns by blanks, nulls left out."""
    keys = {"table_key": table_key, "ddl": ddl, "legacy": legacy}
    col: dict[str, Column] = {n: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("") for n, c in keys.items()}
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in (*(c for c in keys.values() if c), *texts)))
    return rows.select(F.lit(kind).alias("kind"), F.lit(role).alias("role"), *(c.alias(n) for n, c in col.items()), text.alias("text"))


def automaton(words: dict[str, set[str]]) -> ahocorasick.Automaton | None:
    """An automaton whose patterns, the words, carry the concepts that they stand for; None without words."""
    found = ahocorasick.Automaton()
    for word, concepts in words.items():
        found.add_word(word, tuple(sorted(concepts)))
    if not words:
        return None
    found.make_automaton()
    return found


def _needles(concepts: dict[str, list[str]]) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """Words in NFC with their concepts: ASCII ones, lower-cased, and others, which match as they are."""
    low: dict[str, set[str]] = {}
    exact: dict[str, set[str]] = {}
    for concept, words in concepts.items():
        for word in words:
            w = unicodedata.normalize("NFC", word or "")
            if w:
                (low if w.isascii() else exact).setdefault(w.lower() if w.isascii() else w, set()).add(concept)
    return low, exact


def search(things: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """(query, kind, role, table_key, ddl, legacy): things of blobs() whose text contains a word of a concept, each once for each concept.

    ASCII words match whatever their case, others as they stand; texts and words are compared in NFC. Texts are read whole,
    once for all concepts and words: the automaton is made once in a task and its size is that of the stated words. Empty
    words and concepts without words match nothing.
    """
    low, exact = _needles(concepts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(automaton(low), True), (automaton(exact), False)]
        for whole in batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                b = whole.slice(at, READ_ROWS)
                rows, hits = [], []
                for i, text in enumerate(b.column(len(HIT)).to_pylist()):
                    text = unicodedata.normalize("NFC", text) if text and not text.isascii() else text
                    found = {c for finder, fold in finders if finder and text for _, names in finder.iter(text.lower() if fold else text) for c in names}
                    rows += [i] * len(found)
                    hits += found
                keys = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(HIT))]
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), *keys], names=["query", *HIT])

    schema = ", ".join(f"{c} string" for c in ("query", *HIT))
    return things.select(*HIT, "text").mapInArrow(run, schema).distinct()
