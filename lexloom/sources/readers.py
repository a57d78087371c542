"""Sources: Parquet listings, JSON lines, whole texts, HTML, logs and index tables; all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_files(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """Rows of the files of the first glob that matches any; an error if none does."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in patterns or ("*.parquet",):
        target = fs.Path(f"{path}/{p}")
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
            return spark.read.option("pathGlobFilter", p).parquet(path)
    raise FileNotFoundError(f"no file of {patterns or ('*.parquet',)} in {path}")


def json_lines(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """Rows of a JSONL file without malformed lines; the limit counts lines read, bad ones too."""
    text = spark.read.text(path)
    text = text.limit(limit) if limit else text
    parsed = text.select(F.from_json("value", schema).alias("r"), F.col("value"))
    return parsed.filter(F.expr("try_parse_json(value) IS NOT NULL") & F.col("r").isNotNull()).select("r.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def eval_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a JSONL file; blank ids become ``case_%04d`` by line number from 1."""
    raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    w = Window.orderBy("n")
    rows = raw.withColumn("line", F.row_number().over(w)).select("line", F.from_json("value", schema).alias("r")).filter("r IS NOT NULL").select("line", "r.*")
    return rows.withColumn("case_id", F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), F.format_string("case_%04d", F.col("line")))).drop("line")


def whole_texts(spark: SparkSession, path: str, least_lines: int = 5) -> DataFrame:
    """(source_file, content) of the ``*.txt`` files but README, without byte-order mark, of enough lines."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("content"))
    return raw.filter(~F.upper("source_file").startswith("README.") & (F.size(F.split("content", "\n")) >= least_lines))


def log_payloads(lines: DataFrame, marker: str, schema: str) -> DataFrame:
    """JSON payloads after a marker in log lines; works on batches and streams."""
    found = F.regexp_extract("value", rf"{marker}\s+(\{{.*\}})", 1)
    return lines.select(F.from_json(F.nullif(found, F.lit("")), schema).alias("r")).filter("r IS NOT NULL").select("r.*")


def progress_page(line: Column) -> Column:
    return F.regexp_extract(line, r"(?i)\bpage\s*[=:]?\s*(\d+)", 1).try_cast("int")


def index_version(vector: Column, bm25: Column, prefix: tuple[str, str] = ("vec", "bm25")) -> Column:
    """``index_version``, ``updated_at``, ``created_at`` or the prefix of each config struct, joined."""

    def one(c: Column, default: str) -> Column:
        return F.coalesce(c["index_version"], c["updated_at"], c["created_at"], F.lit(default))

    return F.concat_ws("|", one(vector, prefix[0]), one(bm25, prefix[1]))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def table(spark: SparkSession, path: str, where: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A stored table with predicates, order and limit, pushed to the scan where they can be."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit else df
