"""Column functions that compare, embed and rename identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import is_ascii, normal_form, normalize_name

#: Tokens too common to identify a column.
AMBIGUOUS = ("id", "key", "code", "name", "type", "status", "date", "ts", "dt", "num", "no", "ref")
#: Hebrew letters and their Latin spelling.
LETTERS = {
    "א": "a",
    "ב": "b",
    "ג": "g",
    "ד": "d",
    "ה": "h",
    "ו": "v",
    "ז": "z",
    "ח": "kh",
    "ט": "t",
    "י": "y",
    "כ": "k",
    "ך": "k",
    "ל": "l",
    "מ": "m",
    "ם": "m",
    "נ": "n",
    "ן": "n",
    "ס": "s",
    "ע": "a",
    "פ": "p",
    "ף": "p",
    "צ": "ts",
    "ץ": "ts",
    "ק": "q",
    "ר": "r",
    "ש": "sh",
    "ת": "t",
}
DIMENSIONS = 64


def is_hebrew(c: Column) -> Column:
    return c.rlike(r"[\x{0590}-\x{05FF}]")


def is_rtl(c: Column) -> Column:
    """Any Hebrew, Arabic or Syriac code point."""
    return c.rlike(r"[\x{0590}-\x{074F}]")


def ambiguous(c: Column) -> Column:
    return (F.length(c) <= 2) | F.lower(c).isin(*AMBIGUOUS)


def transliterate(c: Column) -> Column:
    """snake_case of a name in NFKC: Hebrew letters spelled out, ASCII lower-cased, the rest one _; col if nothing is left."""
    pairs = list(LETTERS.items())
    single = [(h, latin) for h, latin in pairs if len(latin) == 1]
    out = F.translate(normal_form(c, compatible=True), "".join(h for h, _ in single), "".join(latin for _, latin in single))
    for h, latin in pairs:
        if len(latin) > 1:
            out = F.replace(out, F.lit(h), F.lit(latin))
    out = F.regexp_replace(F.regexp_replace(F.lower(out), r"[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "col").otherwise(out)


def humanize(c: Column) -> Column:
    words = F.initcap(F.replace(F.trim(c), F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "Unknown column").otherwise(words)


@F.pandas_udf(DoubleType())
def _matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _mostly_ascii(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.length(c) > 0.9


def lexical_ratio(a: Column, b: Column) -> Column:
    """1 for equal normalised names, 0 if either is empty or not mostly ASCII, else twice the matching blocks over both lengths."""
    x, y = F.coalesce(normalize_name(a), F.lit("")), F.coalesce(normalize_name(b), F.lit(""))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(_mostly_ascii(x) & _mostly_ascii(y), _matching_blocks(x, y)).otherwise(0.0)


#: What a name's signature counts apart; all other characters are counted together.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789_"


def character_counts(c: Column) -> Column:
    """A normalised name's signature: how often it has each of COUNTED, then how many other characters; made once for each name."""
    x = F.coalesce(normalize_name(c), F.lit(""))
    times = [F.length(x) - F.length(F.replace(x, F.lit(k), F.lit(""))) for k in COUNTED]
    return F.array(*times, F.length(F.regexp_replace(x, f"[{COUNTED}]", "")))


def ratio_bounds(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """struct<low, high> of lexical_ratio(a, b) from signatures of both, without it.

    Matching blocks have no more characters than both names have in common, and the first block is at least as long as
    a common beginning or end. Names that are not mostly ASCII match by equality alone.
    """
    x, y = F.coalesce(normalize_name(a), F.lit("")), F.coalesce(normalize_name(b), F.lit(""))
    both = F.length(x) + F.length(y)
    common = F.aggregate(F.zip_with(counts_a, counts_b, lambda m, n: F.least(m, n)), F.lit(0), lambda s, v: s + v)
    same = lambda k: F.when((F.left(x, F.lit(k)) == F.left(y, F.lit(k))) | (F.right(x, F.lit(k)) == F.right(y, F.lit(k))), k)
    ends = F.coalesce(*(F.when((F.length(x) >= k) & (F.length(y) >= k), same(k)) for k in (12, 8, 6, 4, 3, 2, 1)), F.lit(0))
    point = lambda v: F.struct(F.lit(v).alias("low"), F.lit(v).alias("high"))
    spread = F.struct((2.0 * ends / both).alias("low"), (2.0 * common / both).alias("high"))
    return F.when((x == "") | (y == ""), point(0.0)).when(x == y, point(1.0)).when(_mostly_ascii(x) & _mostly_ascii(y), spread).otherwise(point(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length of the normalised names; built-in functions only."""
    x, y = F.coalesce(normalize_name(a), F.lit("")), F.coalesce(normalize_name(b), F.lit(""))
    return F.when((x == "") | (y == ""), 0.0).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


@F.pandas_udf(ArrayType(DoubleType()))
def hash_vector(text: pd.Series) -> pd.Series:
    """A unit vector drawn from the text's SHA-256; it says whether texts are equal, not what they mean. Null counts as empty."""

    def one(t):
        seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")
        v = np.random.Generator(np.random.PCG64(seed)).standard_normal(DIMENSIONS)
        return v / (np.linalg.norm(v) or 1.0)

    return text.map(one)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; 0 if their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


Score = Callable[[Column, Column], Column]
__all__ = [
    "AMBIGUOUS", "COUNTED", "DIMENSIONS", "LETTERS", "Score", "ambiguous", "character_counts", "dot", "edit_ratio", "hash_vector", "humanize", "is_ascii", "is_hebrew", "is_rtl", "lexical_ratio", "ratio_bounds", "transliterate",
]
