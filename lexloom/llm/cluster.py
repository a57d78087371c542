"""Shared-storage cuts of a plan, size-checked joins and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20
#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``; only a local master may do with a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no recomputation.

    The shuffle files that made it are removed with the write; the table goes
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))
    out = spark.read.parquet(path)
    out.lexloom_path = path
    return out


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*frames: DataFrame) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "lexloom_path", None):
            _file_system(df.sparkSession, path).delete(_hadoop_path(df.sparkSession, path), True)


def sized(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size is below the bound; else Spark shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of many rows to their group, when a group may hold a large part of them.

    ``rows`` of ``right`` (which goes) counts the rows of ``left`` that a group
    has, ``total`` all of them.  Groups of over a thousandth, a thousand at
    most, are broadcast, so that their rows stay where they are; the others
    are shuffled.  No key may be null, and both sides must be cheap to read
    twice (cut tables).
    """
    many = F.col(rows) * 1000 > F.lit(total)
    heavy, light = right.filter(many).drop(rows), right.filter(~many).drop(rows)
    near = left.join(F.broadcast(heavy), keys)
    far = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return near.unionByName(far)


def prime(n: int) -> int:
    """The least prime from ``n`` on: a bucket count that no stride of ids divides."""
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def id_bucket(column, n: int):
    """Bucket of an id, the same as :func:`rolling_bucket` on numpy ids; null ids share one."""
    return F.pmod(F.coalesce(column, F.lit(-(2**63))), F.lit(n).cast("long")).cast("int")


def numbered(df: DataFrame, group: str, order: str, name: str, rows_per_task: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within each group, without a task that holds a whole group.

    Rows of a group are dealt to salts by a hash of ``order``, numbered inside
    each salt, and shifted by the counts of the salts before. ``df`` must be
    cheap to read twice (a cut table).
    """
    most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    salts = int(most // rows_per_task) + 1
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    local = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order)) - 1)
    return (
        local.join(before, local[group].eqNullSafe(before["_g"]) & (local["_salt"] == before["_s"]))
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_salt", "_rn", "_g", "_s", "_before")
    )
