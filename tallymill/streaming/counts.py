"""Counts kept up to date by Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder's parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pairs(stream: DataFrame, items: str = "items") -> DataFrame:
    """(a, b, weight): statements that have both of two items, a < b, for statements with an array of items each."""
    some = F.sort_array(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    rows = stream.select(some.alias("i")).select("i", F.posexplode("i").alias("p", "a"))
    return rows.select("a", F.explode(F.slice("i", F.col("p") + 2, F.size("i"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


def counts(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Rows and summed values for each key, merged by key, so totals don't depend on how rows came in batches."""
    return stream.groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def windowed(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Rows for each key and window of event time; with `late`, for streams without an end, later rows are dropped."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, late) if late else stream).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("item")).agg(F.count("*").alias("n"))


def progress(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """(batch, rows, rows_per_second): a stream's reports, a row a micro-batch."""
    rows = [(int(r["batchId"]), int(r["numInputRows"]), float(r.get("processedRowsPerSecond") or 0.0)) for r in reports]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, rows_per_second double")


def drain(result: DataFrame, keys: list[str], reports: list | None = None) -> DataFrame:
    """Run an aggregation over all input there is now, and return its state: each batch's changes, the last of a key counting.

    reports: a list that gets the stream's progress reports. Updates are appended with their batch number to a table in the shared folder, so a repeated batch changes nothing.
    """
    spark = result.sparkSession
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/state/_b={number}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    if reports is not None:
        reports += [dict(r) if isinstance(r, dict) else json.loads(r.json) for r in query.recentProgress]
    rest = [c for c in result.columns if c not in keys]
    rows = spark.read.parquet(f"{folder}/state")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("s")).select(*keys, "s.*")


def drain_sums(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Run partial, which gives sums by keys, on each micro-batch of all input there is now, and return the sums over the batches.

    Sums need no state between batches: each batch's are written by its number to the shared folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/parts/_b=-1")

    def save(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/parts/_b={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/offsets").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{folder}/parts/*")
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in schema.names if c not in keys))
