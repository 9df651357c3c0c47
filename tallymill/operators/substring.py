"""Substring joins: which texts contain which names, by an inverted index of character q-grams.

A text contains a name only if it has every q-gram of the name, so it is enough to look where the name's rarest one
stands. Names meet texts by an equi-join on that q-gram and are verified on the whole text; no pair of a name and a text
is looked at otherwise. Names shorter than q have lists of their own: their only gram is the name itself. A q-gram that
many texts have is dealt out over several salts, its names copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize, small_side

#: Longest gram; texts of one gram that a salt takes.
Q, SALT_ROWS = 3, 50_000


def grams(text: Column, width: int) -> Column:
    """Distinct runs of `width` characters of a text, none for a shorter one, by a pattern that looks ahead at each place; linear in its length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def _folded(rows: DataFrame, column: str, fold: bool) -> DataFrame:
    value = F.lower(column) if fold else F.col(column)
    return rows.select(value.alias("_v")).where("_v <> ''")


def _verified(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, q: int, fold: bool, salt_rows: int) -> DataFrame:
    """(name, text) pairs, once for each row of texts. Texts are scanned twice, for their grams and for the candidates' verification, and shuffled only if the candidates are too many to broadcast."""
    whole = _folded(texts, text_col, fold).select(F.col("_v").alias("text"), F.xxhash64("_v").alias("_t"))
    name = F.col("name")
    own = materialize(_folded(names, name_col, fold).distinct().select(F.col("_v").alias("name"), F.least(F.char_length("_v"), F.lit(q)).alias("_w")))
    widths = range(1, q + 1)
    each = F.explode(F.coalesce(*(F.when(F.col("_w") == w, grams(name, w)) for w in widths))).alias("gram")
    asked = materialize(own.select("name", each))
    used = [r[0] for r in own.select("_w").distinct().collect()]  # at most q numbers
    every = F.flatten(F.array(*(grams(F.col("text"), w) for w in sorted(used)))) if used else F.array().cast("array<string>")
    wanted = small_side(materialize(asked.select("gram").distinct()), "gram")
    listed = materialize(whole.select("_t", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"))
    df = listed.groupBy("gram").agg(F.count("*").alias("df"))
    # A name with a gram that no text has is in no pair: its least df is null.
    rarest = asked.join(df, "gram", "left").groupBy("name").agg(F.bool_and(F.col("df").isNotNull()).alias("all"), F.min(F.struct("df", "gram")).alias("g")).where("all")
    keyed = materialize(rarest.select("name", "g.gram", F.ceil(F.col("g.df") / salt_rows).cast("int").alias("salts")))
    lists = small_side(materialize(keyed.groupBy("gram").agg(F.max("salts").alias("salts"))), "gram")
    spread = listed.join(lists, "gram").select("_t", "gram", F.pmod(F.xxhash64("_t", F.lit(7)), F.col("salts")).cast("int").alias("salt"))
    dealt = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = materialize(spread.join(small_side(materialize(dealt), "name", "gram"), ["gram", "salt"]).select("name", "_t").distinct())
    # Texts that share a hash are all looked at.
    return whole.join(small_side(met, "name"), "_t").where(F.contains("text", "name")).select("name", "text")


def pairs(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, q: int = Q, fold: bool = True, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(name, text): each pair of a distinct name and a distinct text that contains it, case aside (lower-cased) if fold.

    Nulls and empty texts and names are in no pair; every other text contains itself. Repeated rows count once. Texts are
    read whole, and neither they nor names are capped.
    """
    return _verified(texts, names, text_col, name_col, q, fold, salt_rows).distinct()


def contained(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, q: int = Q, fold: bool = True, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(name): the distinct names that are some text or stand inside one."""
    return _verified(texts, names, text_col, name_col, q, fold, salt_rows).select("name").distinct()


def near_peers(peers: DataFrame, columns: DataFrame, **how) -> DataFrame:
    """(peer, col): distinct peers (peer) and columns (col) of which one contains the other, case aside."""
    inside = pairs(columns, peers, "col", "peer", **how).select(F.col("name").alias("peer"), F.col("text").alias("col"))
    around = pairs(peers, columns, "peer", "col", **how).select(F.col("text").alias("peer"), F.col("name").alias("col"))
    return inside.union(around).distinct()
