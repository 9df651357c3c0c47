"""Readers of column catalogs, table manifests, CREATE TABLE text, chat exports and append logs, and side metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: Administrative verbs, procedure prefixes and system catalogs of statements that tell nothing of a workload.
NOISE = r"(?i)\A\s*(set|use|dbcc|backup|restore)\b|\A\s*(alter|create|drop)\s+database\b|\A\s*(exec(ute)?\s+)?(sp_|xp_)|\bsys\.|\binformation_schema\b|dm_exec|query_store|\bmsdb\.|\bmaster\."


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """(channel, ts, text) of exports with a folder for each channel and a JSON array of messages for each day; blank messages go."""
    rows = spark.read.schema("type string, user string, text string, ts string").option("multiLine", True).json(f"{path}/*/*.json")
    named = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("channel"), "ts", "text")
    return named.where(F.trim("text") != "")


def column_catalog(texts: DataFrame) -> DataFrame:
    """(table_key, pos, col, type) of JSON texts (table_key, value): a list, or an object with columns; a column is a name or {name, type}.

    Invalid texts and blank names give nothing.
    """
    listed = F.coalesce(F.get_json_object("value", "$.columns"), F.when(F.trim("value").startswith("["), F.col("value")))
    items = texts.select("table_key", F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "item"))
    typed = F.when(F.col("item").startswith("{"), F.from_json("item", "name string, type string"))
    rows = items.select("table_key", "pos", F.trim(F.when(F.col("item").startswith("{"), typed["name"]).otherwise(F.col("item"))).alias("col"), F.coalesce(typed["type"], F.lit("")).alias("type"))
    return rows.where("col <> ''")


def manifest_entries(texts: DataFrame) -> DataFrame:
    """(table_key, path, source_dialect, owner, tablespace) of JSON manifests (value); an entry is a path or an object; keys with a leading _ are notes."""
    entries = texts.select(F.explode(F.map_entries(F.from_json("value", "map<string, string>"))).alias("e")).select(F.lower(F.trim("e.key")).alias("table_key"), F.trim("e.value").alias("v"))
    o = F.when(F.col("v").startswith("{"), F.from_json("v", "path string, ddl_path string, source_dialect string, owner string, tablespace string"))
    rows = entries.where(~F.col("table_key").startswith("_")).select("table_key", "v", o.alias("o"))
    return rows.select("table_key", F.when(F.col("o").isNull(), F.col("v")).otherwise(F.coalesce("o.path", "o.ddl_path")).alias("path"), "o.source_dialect", "o.owner", "o.tablespace")


def created_tables(scripts: DataFrame) -> DataFrame:
    """(script, table_key, owner, tablespace), lower-cased, for each CREATE TABLE in scripts (script, sql); a tablespace stands within 500 characters."""
    found = F.regexp_extract_all(F.lower("sql"), F.lit(r"(?s)create\s+table\s+[a-z0-9_$.]+\s*\((?:(?!create\s+table).){0,500}"), F.lit(0))
    parts = scripts.select("script", F.explode(found).alias("t")).select("script", F.regexp_extract("t", r"create\s+table\s+([a-z0-9_$.]+)", 1).alias("table_key"), F.regexp_extract("t", r"\)\s*(?:tablespace|in)\s+([a-z0-9_$]+)", 1).alias("s"))
    owner = F.when(F.col("table_key").contains("."), F.element_at(F.split("table_key", r"\."), -2))
    return parts.select("script", "table_key", owner.alias("owner"), F.when(F.col("s") != "", F.col("s")).alias("tablespace"))


def glossary_inventory(entries: DataFrame) -> DataFrame:
    """(file, layer, entries): files (file, term, target) with the layer dirty if their name says so, else clean; notes don't count."""
    layer = F.when(F.lower("file").contains("dirty"), "dirty").otherwise("clean")
    return entries.where(~F.col("term").startswith("_")).groupBy("file").agg(F.count("*").alias("entries")).select("file", layer.alias("layer"), "entries")


def side_metadata(items: DataFrame, comments: DataFrame) -> DataFrame:
    """items (db, schema, table, ...) with comment: of comments (key, comment), that of the full name, else schema.table, else the table."""
    c = comments.groupBy(F.lower("key").alias("_k")).agg(F.min("comment").alias("_c"))
    rows, found = items, []
    for i, parts in enumerate((("db", "schema", "table"), ("schema", "table"), ("table",))):
        rows = rows.join(c.select(F.col("_k").alias(f"_k{i}"), F.col("_c").alias(f"_c{i}")), F.lower(F.concat_ws(".", *parts)) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_c{i}"))
    return rows.select(*items.columns, F.coalesce(*found).alias("comment"))


def latest_entries(spark: SparkSession, path: str, schema: str, most: int = 50) -> DataFrame:
    """The newest rows of an append log of JSON lines, by timestamp; bad lines go."""
    rows = spark.read.schema(f"{schema}, timestamp timestamp, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad").orderBy(F.col("timestamp").desc(), *[c.split()[0] for c in schema.split(", ")]).limit(most)


def is_noise(sql: Column) -> Column:
    """Blank statements, administration and reads of system catalogs."""
    return (F.trim(F.coalesce(sql, F.lit(""))) == "") | F.coalesce(sql.rlike(NOISE), F.lit(False))


def mentions_schema(sql: Column, schemas: list[str]) -> Column:
    """A statement names one of the schemas, bare or in brackets; without schemas all do."""
    return F.coalesce(sql.rlike(rf"(?i)(?<![a-z0-9_])\[?({'|'.join(rf'\Q{s}\E' for s in schemas)})\]?\."), F.lit(False)) if schemas else F.lit(True)


def of_schemas(log: DataFrame, schemas: list[str], sql: str = "sql") -> tuple[DataFrame, dict[str, int]]:
    """Statements that mention one of the schemas, written, and how many were kept and skipped, observed meanwhile."""
    seen = Observation()
    marked = log.withColumn("_kept", mentions_schema(F.col(sql), schemas))
    watched = marked.observe(seen, F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("skipped"))
    return materialize(watched.where("_kept").drop("_kept")), dict(seen.get)


def qualified(key: Column) -> Column:
    return key.contains(".")


def search(rows: DataFrame, text: str, columns: list[str], done: DataFrame | None = None, key: str = "item", most: int | None = None) -> DataFrame:
    """Rows that have the text in one of the columns, case aside, those of done (key) left out; the first by key if most is stated."""
    hits = rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
    hits = hits if done is None else hits.join(done.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return hits if most is None else hits.orderBy(key).limit(most)
