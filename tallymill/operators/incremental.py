"""Incremental loads: rows newer than a target's newest, merged into a partitioned table by unique key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.scratch import materialize

#: What makes a column's name one of time, and of these, of event time or of file time.
TIME_LIKE = re.compile("time|timestamp|_at|_ts|_dt")
EVENT_TIME = ("event", "occur", "occurred", "processing_time", "processed_at")
FILE_TIME = ("file", "ingest", "ingestion", "source", "loaded", "load_at", "received")
START = "1900-01-01 00:00:00"
#: Folders that a load rewrites are named by this column.
BUCKET, BUCKETS = "_bucket", 64
#: Rows of a file.
FILE_ROWS = 5_000_000


def ordering_column(columns: list[str]) -> tuple[str, str]:
    """The column that orders increments and its strategy: the first one of event time, else of file time, else any of time, else the first column (id without columns)."""
    names = [c.strip() for c in columns if c and c.strip()]
    timed = [c for c in names if TIME_LIKE.search(c.lower())]
    for words, strategy in ((EVENT_TIME, "event-time"), (FILE_TIME, "file-time")):
        for c in timed:
            if any(w in c.lower() for w in words):
                return c, strategy
    return (timed or names or ["id"])[0], "file-time"


def unique_key(key: str | list[str] | None) -> list[str]:
    """The key's columns; none, or only blank ones, is an error."""
    names = [k for k in ([key] if isinstance(key, str) else key or []) if k and k.strip()]
    if not names:
        raise ValueError("an incremental table needs a unique key")
    return names


def newest(target: DataFrame | None, order: str):
    """The greatest value of the ordering column in a target; None without rows."""
    return None if target is None else target.agg(F.max(order)).first()[0]


def beyond(source: DataFrame, target: DataFrame | None, order: str | None = None) -> DataFrame:
    """Rows of source whose ordering column, inferred unless named, is greater than the target's greatest value.

    Without a target, or with an empty one, times count from 1900-01-01 and other types from their least value; rows
    with a null there are never new.
    """
    order = order or ordering_column(source.columns)[0]
    top = newest(target, order)
    if top is None:
        timed = dict(source.dtypes)[order].split("(")[0] in ("timestamp", "timestamp_ntz", "date")
        return source.where(F.col(order) > F.lit(START).cast(source.schema[order].dataType)) if timed else source.where(F.col(order).isNotNull())
    return source.where(F.col(order) > F.lit(top))


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ordering value, then the greatest other columns: a partial aggregate. Null keys group together."""
    rest = [c for c in rows.columns if c not in key and c != order]
    top = F.max(F.struct(F.col(order), *(F.struct(F.col(c).isNotNull().alias("some"), F.col(c)) for c in rest))).alias("_top")
    out = rows.groupBy(*key).agg(top)
    return out.select(*(F.col(c) if c in key else F.col(f"_top.{order}") if c == order else F.col("_top")[f"col{rest.index(c) + 2}"][c].alias(c) for c in rows.columns))


def bucket_of(key: list[str], buckets: int) -> Column:
    """A row's folder, by its key alone, so new versions of a key replace old ones in place."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that loads have written under path, without its folder column; None before the first."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows.drop(BUCKET)


def merge(rows: DataFrame, path: str, key: str | list[str], order: str, buckets: int = BUCKETS) -> int:
    """Merge rows into the table under path by unique key, the greatest ordering value winning; returns the number of keys among rows.

    Only the folders of these keys are read, merged and overwritten, by one commit; other folders aren't touched. The
    merged rows are written to the scratch folder first, as a folder can't be read while it is overwritten. A merge that
    is run again changes nothing; one that failed before its commit left the table as it was. Nulls may stand in any column.
    """
    spark, names = rows.sparkSession, unique_key(key)
    fresh = materialize(latest_rows(rows, names, order).withColumn(BUCKET, bucket_of(names, buckets)))
    count = fresh.count()
    if not count:
        return 0
    merged, columns = fresh, [BUCKET, *rows.columns]
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    if read_target(spark, path) is not None:
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        both = old.select(*columns).unionByName(fresh.select(*columns))
        merged = materialize(latest_rows(both, [BUCKET, *names], order))
        count_all = merged.count()
    else:
        count_all = count
    files = -(-count_all // (len(touched) * FILE_ROWS))
    dealt = merged.repartition(len(touched) * files, BUCKET, F.pmod(F.xxhash64(F.lit(1), *names), F.lit(files)))
    dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(path)
    return count


def load(source: DataFrame, path: str, key: str | list[str], order: str | None = None, buckets: int = BUCKETS) -> int:
    """merge() of the source's rows beyond the table's greatest ordering value; a load that is run again finds none."""
    unique_key(key)
    order = order or ordering_column(source.columns)[0]
    return merge(beyond(source, read_target(source.sparkSession, path), order), path, key, order, buckets)


def load_stream(stream: DataFrame, path: str, checkpoint: str, key: str | list[str], order: str, buckets: int = BUCKETS) -> None:
    """merge() of each micro-batch of all that a stream has now. Batches may bring rows in any order, and a batch that is run again changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        merge(batch, path, key, order, buckets)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
