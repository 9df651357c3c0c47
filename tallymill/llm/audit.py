"""Filter interaction audit: what each filter removes, alone and behind others, for every order of the filters.

Every filter has a failing-id relation, a table of the rows that fail it, stored in the scratch folder. Joins on these
relations give the rest. For an order, survivors of a prefix are what left-anti joins with its filters' relations leave;
a step removes the left-semi join of the survivors with its own relation; it is redundant on the rest of that relation.

`trace` does this row by row for one order. `audit` covers all orders at once. Rows of one part and one kind of label
that stand in the same relations behave alike everywhere, so they are first counted together as a cell. The relations
carry over from rows to cells, and anti and semi joins of (order, step, cell) with them give every prefix. So rows are
shuffled once, not once for each of the prefixes, and a hot part or label is a partial count.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, quoted, small_side

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 3, r"[#$%&*|]"
FILTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(row, doc_id, part, digest, A, B, C, D), written: one scan of the texts. row is a number of its own for each row; digest is the text's SHA-256."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    part = F.coalesce(F.col(quoted(part_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), part.alias("part"), text.alias("text"))
    flags = [c.alias(f) for f, c in text_filters(F.col("text")).items()]
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *flags))


def repeats(rows: DataFrame) -> DataFrame:
    """(row) of the rows whose text a smaller doc_id has too; a null doc_id is greater than all others.

    Only texts that occur more than once are joined back; their number and least id are partial aggregates.
    """
    least = rows.groupBy(F.col("digest").alias("_digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1 and least is not null")
    wide = ["least"] if dict(rows.dtypes)["doc_id"] == "string" else []
    known = small_side(materialize(least.select("_digest", "least")), "_digest", *wide)
    later = (F.col("digest") == F.col("_digest")) & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return rows.join(known, later).select("row")


def relations(rows: DataFrame) -> dict[str, DataFrame]:
    """The failing-id relation of each filter: a written table (row), each row once."""
    found = {f: materialize(rows.where(F.col(f)).select("row")) for f in "ABCD"}
    return found | {"E": materialize(repeats(rows))}


def trace(rows: DataFrame, failing: dict[str, DataFrame], order: str) -> DataFrame:
    """(row, doc_id, part, step, filter, outcome) for one order: each row is removed at one step or kept (step null), and redundant at each later step whose filter it fails."""
    columns = ["row", "doc_id", "part"]
    left, out = rows.select(*columns), []
    say = lambda df, step, name, what: df.select(*columns, F.lit(step).cast("int").alias("step"), F.lit(name).cast("string").alias("filter"), F.lit(what).alias("outcome"))
    for step, name in enumerate(order, 1):
        out.append(say(left.join(failing[name], "row", "left_semi"), step, name, "removed"))
        gone = failing[name].join(left, "row", "left_anti")
        out.append(say(rows.join(gone, "row", "left_semi"), step, name, "redundant"))
        left = materialize(left.join(failing[name], "row", "left_anti"))
    out.append(say(left, None, None, "kept"))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every


def cells(rows: DataFrame, failing: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(cell, part, good, toxic, fails, n): rows of a part with the same labels in the same relations, counted. cell is their common key.

    labels is (doc_id, quality, toxic); a document is good or toxic if any of its label rows says 1. The joins on row share one shuffle of the rows.
    """
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    known = rows.join(says, F.col("doc_id") == F.col("_id"), "left").select("row", "part", one("quality").alias("good"), one("toxic").alias("toxic"))
    for name, ids in failing.items():
        known = known.join(ids.withColumn(name, F.lit(name)), "row", "left")
    counted = known.select("part", "good", "toxic", F.concat_ws("", *failing).alias("fails")).groupBy("part", "good", "toxic", "fails").agg(F.count("*").alias("n"))
    return materialize(counted.withColumn("cell", F.concat_ws("/", "fails", F.col("good").cast("string"), F.col("toxic").cast("string"), "part")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    Null texts are empty, null parts are the empty part. Null ids take part and have no labels; rows that repeat an id
    are documents of their own, and not repeats of each other for filter E. Labels of unknown ids, null labels and
    repeated ones are harmless. Other columns are ignored. No rows in, no parts and no rows out.
    """
    rows = facts(docs, id_col, text_col, part_col)
    counted = cells(rows, relations(rows), labels)
    fails = counted.select("cell", F.explode(F.split("fails", "")).alias("filter")).where("filter <> ''")  # the relations, over cells
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counted.select("cell", F.explode(orders).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    # A cell is gone before the steps that follow its first failure.
    first = steps.join(fails, ["cell", "filter"], "left_semi").groupBy("cell", "filter_order").agg(F.min("step").alias("first"))
    gone = materialize(first.select("cell", "filter_order", F.explode(F.sequence("first", F.lit(len(FILTERS)))).alias("after")).select("cell", "filter_order", (F.col("after") + 1).alias("step")))
    on = ["cell", "filter_order", "step"]
    survivors = steps.join(gone, on, "left_anti")
    removed = survivors.join(fails, ["cell", "filter"], "left_semi").withColumn("what", F.lit("removed"))
    kept = survivors.join(fails, ["cell", "filter"], "left_anti").withColumn("what", F.lit("kept"))
    redundant = steps.join(fails, ["cell", "filter"], "left_semi").join(gone, on, "left_semi").withColumn("what", F.lit("redundant"))
    single = fails.groupBy("cell").agg(F.count("*").alias("k")).where("k = 1")
    unique = steps.join(fails, ["cell", "filter"], "left_semi").join(single, "cell", "left_semi").withColumn("what", F.lit("unique"))
    size = counted.select("cell", "part", "good", "toxic", "n")
    listed = steps.withColumn("what", F.lit("listed"))  # every part, order and step has a row
    every = listed.unionByName(kept).unionByName(removed).unionByName(redundant).unionByName(unique).join(size, "cell")
    is_ = lambda what: F.col("what") == what
    count = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(name)
    out = every.groupBy("part", "filter_order", "step", "filter").agg(
        count(is_("kept"), "kept"), count(is_("removed"), "removed"), count(is_("redundant"), "redundant"), count(is_("unique"), "unique_fails"),
        count(is_("removed") & F.col("good"), "good_lost"), count(is_("removed") & F.col("toxic"), "toxic_lost"),
    )
    out = materialize(out)
    shapley = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
