"""What the operators here share; scratch tables and components come from the library."""

from __future__ import annotations

import re
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.scratch import drop_scratch, free_name, materialize, scratch_dir, small_side

__all__ = ["WORD", "components", "drop_scratch", "free_name", "materialize", "odd_names_aside", "quoted", "scratch_dir", "slices", "small_side", "table", "word_count"]

#: A word, as every operator here reads it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def word_count(text: Column | str) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def odd_names_aside(f):
    """f(docs, ...) with columns of docs whose names aren't plain words (dots, backticks, blanks) numbered meanwhile: functions on Arrow batches resolve columns by name."""

    @wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        odd: dict[str, str] = {}
        for i, c in enumerate(docs.columns):
            if not re.fullmatch(r"\w+", c):
                odd[c] = free_name(docs, f"_column_{i}")
        if not odd:
            return f(docs, *args, **kwargs)
        out = f(docs.toDF(*(odd.get(c, c) for c in docs.columns)), *args, **kwargs)
        back = {plain: c for c, plain in odd.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


def slices(batches, column: int, most: int = 1 << 20):
    """Arrow batches cut so that a slice holds about `most` bytes of a string or binary column, or one longer text.

    The column may also be a number: the bytes that its row takes.
    """
    for b in batches:
        size = b.column(column)
        size = size if pa.types.is_integer(size.type) else pc.binary_length(size)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, end - at)
            at = end
