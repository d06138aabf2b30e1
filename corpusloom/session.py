"""Session helpers: reading tables, cutting lineage in the shared folder, and joins with a checked small side."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows and bytes (as Spark estimates them from the written files).
SMALL_ROWS = 200_000
SMALL_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set, else (tests) a local one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-")
    return "file://" + _own


_own: str | None = None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back: later uses neither recompute it nor depend on
    the executors that made it. An empty frame comes back empty with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (exact file sizes for a frame that was just materialized)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is a written table under `rows` rows and SMALL_BYTES bytes; else as it is,
    so that Spark shuffles both sides."""
    if bytes_of(df) <= SMALL_BYTES and df.count() <= rows:
        return F.broadcast(df)
    return df


def repo_file(*parts: str) -> str:
    return os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), *parts)
