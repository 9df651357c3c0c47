"""Scratch tables in the shared folder, and joins whose small side is broadcast only after its size is measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

_LOCAL: dict = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL.setdefault("path", None) or tempfile.mkdtemp(prefix="spark-scratch-")
        _LOCAL["path"] = path
    return path.rstrip("/")


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors. compression is the session's unless named; for whole texts, zstd takes less disk."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it new among df's columns (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Largest table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, *wide: str) -> DataFrame:
    """A materialised df hinted for broadcast if its measured size allows, else for a shuffled hash join that builds it.

    wide: its string, binary and array columns, by name; an array's elements count as 32 bytes each.
    """
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    bytes_of = lambda c: 32 * F.size(c) if c in arrays else F.octet_length(F.col(c).cast("binary"))
    width = sum((F.greatest(F.coalesce(bytes_of(c), F.lit(0)), F.lit(0)) for c in wide), F.lit(64))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("shuffle_hash")
