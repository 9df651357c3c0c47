"""Readers of query logs, messages and SQL files, and the sink of rejected records."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LINE = 2 * 1024 * 1024
#: Files that one task writes.
FILES = 1_000
LOG_SCHEMA = "sql string, query string, statement string, env string, dialect string, batch_id bigint, chunk_id bigint"


def all_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines (value) of any length, NUL removed, from files under paths."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(paths)
    return rows.select(F.regexp_replace("value", "\\x00", "").alias("value")).where(F.trim("value") != "")


def lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl", longest: int | None = MAX_LINE) -> DataFrame:
    """all_lines() of at most `longest` characters; None takes all. What is longer is for too_long()."""
    rows = all_lines(spark, paths, glob)
    return rows if longest is None else rows.where(F.length("value") <= longest)


def too_long(rows: DataFrame, stage: str, run_id: str, longest: int = MAX_LINE) -> DataFrame:
    """Dead letters of the lines of all_lines() that lines() leaves out."""
    return _letters(rows.where(F.length("value") > longest), "value", f"line over {longest} characters", stage, run_id)


def _letters(bad: DataFrame, payload: str, reason: str, stage: str, run_id: str) -> DataFrame:
    return bad.select(F.col(payload).alias("original_payload"), F.lit(reason).alias("error_reason"), F.lit(stage).alias("error_stage"), F.current_timestamp().alias("timestamp"), F.lit(run_id).alias("run_id"))


def parse_log(rows: DataFrame) -> DataFrame:
    """(sql, env, dialect, batch_id, chunk_id, corrupt): sql is the first non-empty of three fields; corrupt has a line that isn't JSON."""
    parsed = F.from_json("value", LOG_SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    some = [F.when(F.col(f"r.{c}") != "", F.col(f"r.{c}")) for c in ("sql", "query", "statement")]
    return rows.select("value", parsed.alias("r")).select(F.coalesce(*some, F.lit("")).alias("sql"), "r.env", "r.dialect", "r.batch_id", "r.chunk_id", F.col("r._corrupt").alias("corrupt"))


def read_log(spark: SparkSession, paths: str | list[str], max_records: int | None = None) -> DataFrame:
    """Valid records of JSONL query logs; max_records counts these alone."""
    good = parse_log(lines(spark, paths)).where("corrupt is null").drop("corrupt")
    return good if max_records is None else good.limit(max_records)


def dead_letters(rows: DataFrame, stage: str, run_id: str) -> DataFrame:
    """Rejected records of parse_log, with reason, stage, time and run."""
    return _letters(rows.where("corrupt is not null"), "corrupt", "invalid JSON", stage, run_id)


def read_messages(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(text, ts, channel, meta) of flat message JSONL; rows without text go; fields not named here stay in meta."""
    m = F.from_json("value", "map<string,string>")
    first = lambda *keys: F.coalesce(*(F.when(F.col("m")[k] != "", F.col("m")[k]) for k in keys))
    rows = lines(spark, paths, glob).select(m.alias("m")).select(first("text", "body").alias("text"), first("ts", "timestamp").alias("ts"), first("channel").alias("channel"), F.map_filter("m", lambda k, v: ~k.isin("text", "body", "ts", "timestamp", "channel")).alias("meta"))
    return rows.where("text is not null")


def combined(*sources: DataFrame, labels: list[str]) -> DataFrame:
    """(text, ts, channel, meta, origin): messages of several readers as one table, each with its source's label; a column that a source lacks is null."""
    rows = [s.withColumn("origin", F.lit(label)) for s, label in zip(sources, labels, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def read_sql_files(spark: SparkSession, roots: str | list[str], glob: str = "*.{sql,SQL}") -> DataFrame:
    """(path, text) of .sql files under roots, whole."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(roots, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).distinct()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_sql_files(rows: DataFrame, path: str) -> None:
    """A file for each row (name STRING, text STRING): name=<name, percent-encoded>.sql, name.sql for a null, each text with a line end behind it.

    Rows are dealt to tasks by their number, as a table of names is small in bytes and would be one task's. Each task has a
    folder of its own; rows of equal names go to one task, the second and later to folders beside it. A file is moved into
    place when it is whole, so tasks may run again. Spark's writer would take a folder and a commit for each name and,
    on a local disk, run chmod for each file and folder.
    """

    def write(part):
        store, root = _store(path)
        last, again, folder = (), 0, ""
        for name, text in part:
            again = again + 1 if (name,) == last else 0
            last, into = (name,), f"{root}/{TaskContext.get().partitionId():06d}{f'-{again}' if again else ''}"
            if into != folder:
                store.create_dir(folder := into, recursive=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(f"{text or ''}\n".encode())
            store.move(draft, f"{folder}/name{'' if name is None else '=' + quote(name, safe='')}.sql")

    n = max(1, -(-rows.count() // FILES))
    rows.select("name", "text").repartition(n, "name").sortWithinPartitions("name", "text").foreachPartition(write)


def write_tickets(rows: DataFrame, path: str) -> None:
    """One CSV row a table, every field quoted, texts on one line."""
    flat = lambda c: F.array_join(F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), " | ")
    rows.select(*(flat(F.col(c).cast("string")).alias(c) for c in rows.columns)).write.option("header", True).option("quoteAll", True).csv(path)
