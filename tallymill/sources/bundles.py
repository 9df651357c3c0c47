"""Result bundles, extraction artefacts, decisions, audit trails and model manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType
from pyspark.sql.utils import AnalysisException

#: Signs of a run's id that don't go into a folder's name.
F_SAFE = re.compile(r"[^A-Za-z0-9_.-]")

MODEL = "struct<resource_type: string, name: string, schema: string, alias: string, original_file_path: string, columns: map<string, string>, config: struct<materialized: string, unique_key: string>>"


def write_bundle(blocks: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each block of a result set."""
    for name, rows in blocks.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_extraction(catalog: DataFrame, statements: DataFrame, path: str) -> None:
    """Column lists (schema, table, col, type) as JSON by schema under catalog/, statements (env, dialect, sql) as JSON lines under log/."""
    columns = F.sort_array(F.collect_list(F.struct(F.col("col").alias("name"), F.col("type"))))
    catalog.groupBy("schema", "table").agg(columns.alias("columns")).write.partitionBy("schema").json(f"{path}/catalog")
    statements.select("env", "dialect", "sql").write.json(f"{path}/log")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(schema, table, col, type) of column lists that write_extraction wrote; unreadable files give nothing."""
    rows = spark.read.schema("schema string, table string, columns array<struct<name: string, type: string>>").json(f"{path}/catalog")
    return rows.select("schema", "table", F.explode("columns").alias("c")).select("schema", "table", F.col("c.name").alias("col"), F.col("c.type").alias("type"))


def review_decisions(texts: DataFrame) -> DataFrame:
    """(signature, action) in JSON texts (value) of the form {"decisions": {signature: {"action": ...}}}; null or invalid texts give none."""
    parsed = F.from_json("value", "decisions map<string, struct<action: string>>")
    return texts.select(F.explode(F.map_entries(parsed["decisions"])).alias("d")).select(F.col("d.key").alias("signature"), F.col("d.value.action").alias("action"))


def audit_rows(scored: DataFrame, flags: DataFrame) -> DataFrame:
    """Audit entries: scored (item, decision, confidence, reason, contract, approver) with its flags and primary_reason, the first flag's reason else the score's.

    Flags stand in the order BLOCK, WARN, INFO, then by name and reason.
    """
    rank = F.when(F.col("level") == "BLOCK", 0).when(F.col("level") == "WARN", 1).otherwise(2)
    per = flags.groupBy("item").agg(F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "name", "reason", "level"))).alias("_f"))
    listed = F.transform(F.coalesce("_f", F.array().cast("array<struct<rank: int, name: string, reason: string, level: string>>")), lambda f: F.struct(f["level"].alias("level"), f["name"].alias("name"), f["reason"].alias("reason")))
    return scored.join(per, "item", "left").select(*scored.columns, listed.alias("flags"), F.coalesce(F.get("_f", F.lit(0))["reason"], "reason").alias("primary_reason"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit entries, stamped with the time, as JSON lines."""
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def append_run(rows: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's audit entries, stamped with the time, exactly once; false if the run is there already.

    The entries go to a folder of their own, and an entry of the run in the manifest, written last, makes them visible. A
    job that failed in between, and one that is started twice, writes the same folder again: nothing is doubled or half seen.
    """
    spark = rows.sparkSession
    known = read_runs(spark, path)
    if known is not None and not known.where(F.col("run_id") == run_id).isEmpty():
        return False
    folder = f"run={F_SAFE.sub(lambda m: '%' + m[0].encode().hex(), run_id)}"
    rows.withColumn("run_id", F.lit(run_id)).withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").json(f"{path}/entries/{folder}")
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("finished")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{folder}")
    return True


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """(run_id, finished) of the runs that an audit log shows; None before the first."""
    try:
        return spark.read.schema("run_id string, finished timestamp").json(f"{path}/manifest/*")
    except AnalysisException:
        return None


def read_audit(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of an audit log that append_run() wrote, with run_id and timestamp; those of unfinished runs are left out."""
    runs = read_runs(spark, path)
    whole = StructType([*schema.fields, StructField("run_id", StringType()), StructField("timestamp", TimestampType())])
    if runs is None:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).json(f"{path}/entries/*").join(runs.select("run_id").distinct(), "run_id", "left_semi").select(*whole.names)


def model_nodes(texts: DataFrame) -> DataFrame:
    """(model, relation, materialized, columns, unique_key ARRAY, path) of the models in manifests (value: JSON text).

    Only nodes of the type model that have a name count; a relation is schema.alias, the name standing in for a missing
    alias; unique_key may be one name or a list; invalid texts give none.
    """
    nodes = F.from_json("value", f"nodes map<string, {MODEL}>")["nodes"]
    n = texts.select(F.explode(F.map_values(nodes)).alias("n")).select("n.*").where((F.lower("resource_type") == "model") & (F.col("name") != ""))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.col("config.unique_key")
    keys = F.when(key.startswith("["), F.from_json(key, "array<string>")).when(key != "", F.array(key))
    names = F.sort_array(F.coalesce(F.map_keys("columns"), F.array().cast("array<string>")))
    return n.select(F.col("name").alias("model"), F.concat_ws(".", some("schema"), F.coalesce(some("alias"), "name")).alias("relation"), F.coalesce(some("config.materialized"), F.lit("view")).alias("materialized"), names.alias("columns"), keys.alias("unique_key"), F.col("original_file_path").alias("path"))
