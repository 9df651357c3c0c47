"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

The published function is a walk. Shard 0 holds every key at first; a generator seeded with the key says at which number
of shards the key jumps next, and the last jump below the present number is its shard. The walk doesn't depend on that
number, so when shards are appended a key stays where it is or jumps into a new one, and with n shards grown to m just
the share (m - n) / m moves.

A step is the generator's multiplication modulo 2**64, done here on 32-bit halves that never overflow a BIGINT. Keys are
the first 64 bits of the MD5 of the id as text, so ids of any type, and ids that are multiples of something, spread
evenly. Everything is built-in functions; slots in a shard are numbered by ranges, so no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted

SHARDS, LAW, FILE_BYTES = 16, "key", 256 << 20
#: Fixed values of the published function: its generator's multiplier in 32-bit halves.
FACTOR_HIGH, FACTOR_LOW = 0x27BB2EE6, 0x87B0B0FD
#: Steps of the walk that a first fold takes; over n shards it takes about ln(n), so hardly a key needs a second fold.
STEPS = 48
_MASK, _HALF = (1 << 32) - 1, (1 << 16) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def key_of(id_col: Column) -> Column:
    """struct<hi, lo>: 64 bits of an id, by its text; a null id has the key of an empty text."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(part(1).alias("hi"), part(9).alias("lo"))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * FACTOR + 1 modulo 2**64, from 16-bit parts of the halves."""
    low16 = lambda x: x.bitwiseAND(_long(_HALF))
    times = lambda x: (low16(x) * _long(FACTOR_LOW), F.shiftright(x, 16) * _long(FACTOR_LOW))
    a, b = times(lo)
    low = a + F.shiftleft(low16(b), 16) + _long(1)
    carry = F.shiftright(low, 32) + F.shiftright(b, 16)
    c, d = times(hi)
    high = c + F.shiftleft(low16(d), 16) + lo * _long(FACTOR_HIGH) + carry
    return high.bitwiseAND(_long(_MASK)), low.bitwiseAND(_long(_MASK))


def _walk(state: Column, shards: int, most: int, first: int, last: int) -> Column:
    """Steps first..last of the walk; what has passed `most` stands still. was: the last jump below shards, at: below most."""

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1))).cast("long")
        was = F.when(s["next"] < shards, s["next"]).otherwise(s["was"])
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), was.alias("was"), s["next"].alias("at"), jump.alias("next"))
        return F.when(s["next"] >= most, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, step)


def walked(rows: DataFrame, id_col: str, shards: int, grown: int) -> DataFrame:
    """rows with the shards of each id among `shards` and among `grown` >= shards, as the struct's was and at."""
    if not 0 < shards <= grown:
        raise ValueError("the number of shards must be positive and may only grow")
    k, w = free_name(rows, "_key"), free_name(rows, "_walk")
    start = F.struct(F.col(f"{k}.hi"), F.col(f"{k}.lo"), _long(0).alias("was"), _long(0).alias("at"), _long(0).alias("next"))
    # The first step of every walk leads to shard 0.
    out = rows.withColumn(k, key_of(F.col(quoted(id_col)))).withColumn(w, _walk(start, shards, grown, 1, min(grown, STEPS)))
    if grown > STEPS:
        out = out.withColumn(w, F.when(F.col(f"{w}.next") >= grown, F.col(w)).otherwise(_walk(F.col(w), shards, grown, STEPS + 1, grown)))
    return out.withColumn("shard", F.col(f"{w}.was").cast("int")).withColumn("grown_shard", F.col(f"{w}.at").cast("int")).drop(k, w)


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with a column more, the shard of each row; name must be new to docs. Null ids share the shard of the empty text."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {name}")
    spot = free_name(docs, "_spot")
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias(spot), F.col(quoted(id_col)).alias("_id"))
    out = walked(rows, "_id", shards, shards)
    return out.select(*(F.col(f"{spot}.c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("shard").alias(name))


def moved(docs: DataFrame, shards: int, grown: int, id_col: str = "doc_id") -> DataFrame:
    """(id, from_shard, to_shard): the rows that move when `shards` become `grown`; every to_shard is a new one."""
    rows = walked(docs.select(F.col(quoted(id_col)).alias("_id")), "_id", shards, grown).where("shard <> grown_shard")
    return rows.select(F.col("_id").alias(id_col), F.col("shard").alias("from_shard"), F.col("grown_shard").alias("to_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """docs as Parquet under path, a folder shard=n each, in files of about file_bytes of text.

    The files of a shard are dealt by a hash of id and text, so one shard is several tasks. Reading the folder gives docs with shard.
    """
    text = F.col(quoted(text_col))
    total = docs.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 1).alias("n")).first()["n"] or 0
    files = max(1, -(-total // (shards * file_bytes)))
    part = F.pmod(F.xxhash64(F.col(quoted(id_col)), text), F.lit(files))
    placed = place(docs, shards, id_col)
    placed.repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row per row of docs.

    size is the UTF-8 bytes of the text plus one, text_crc32 its unsigned CRC-32; a null text counts as an empty one.
    grown_shard is the shard with one shard more. slot numbers a shard's rows from 0 by id (nulls last), CRC and size;
    rows equal in these are alike in every column but slot. Null ids share one shard, repeated rows are rows of their
    own, equal texts have no bearing on the shard. Other columns are ignored. No rows in, none out.
    """
    raw = F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")
    facts = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row")
    )
    rows = materialize(walked(facts, "doc_id", shards, shards + 1))
    order = [F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "row"]
    dealt = materialize(rows.repartitionByRange("shard", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    out = dealt.join(base, ["shard", "part"]).withColumn("slot", (inside + F.col("base")).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
