"""The folder that all executors share, and tables kept there for one application."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files below this size in all may be a single row group, which one task reads however many splits it is given.
ONE_GROUP = 128 << 20

_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def state(spark: SparkSession, source: str) -> str:
    """A digest of the path, length and time of every file below ``source``; folders have no times in many stores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def kept(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` wrote for the files of ``source``, once per application and state of the files; it goes with the driver."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    key = (spark.sparkContext.applicationId, name, source, state(spark, source))
    if key not in _KEPT:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build(path)
        fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(fs_path(path))
        _KEPT[key] = path
    return _KEPT[key]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what several branches of a plan need runs once; it goes with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, source: str) -> DataFrame:
    """``df`` of the files of ``source`` over all cores before heavy work on texts: dealt out anew only if the files are small."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < ONE_GROUP else df
