"""Sinks: JSON lines, manifests, event logs and benchmark outputs; indexes are written by their operators through :mod:`versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.corpus import frequencies, token_bucket


def documents_jsonl(docs: DataFrame, path: str) -> None:
    docs.drop("content_length").write.mode("overwrite").json(path)


def manifest(docs: DataFrame, top: int = 10) -> DataFrame:
    """One row: totals, lengths, counts by type, top issuers."""
    n = F.length("content")
    base = docs.agg(F.count(F.lit(1)).alias("total"), F.bround(F.avg(n)).cast("long").alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))
    types = frequencies(docs, F.col("doc_type")).agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("by_type"))
    issuers = frequencies(docs, F.col("issuer"), top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "value"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["value"].alias("value"), (-x["minus_n"]).alias("n"))).alias("top_issuers"))
    return base.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(issuers))  # one row each


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(token_bucket(F.col("token_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def failures_csv(results: DataFrame, path: str) -> None:
    """Rows whose primary label is neither PASS nor blank; label lists joined by a bar, others by a semicolon."""
    bad = results.filter(~F.coalesce(F.trim("primary_label"), F.lit("")).isin("PASS", ""))
    lists = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|" if "label" in c else ";") for c, t in bad.dtypes if t.startswith("array")}
    bad.withColumns(lists).write.mode("overwrite").option("header", True).csv(path)


def append_records(records: DataFrame, path: str, url: str = "url") -> None:
    """Crawl records that the output does not hold yet, once per normalised URL."""
    from lexloom.functions.text import normal_url

    new = records.withColumn("_key", normal_url(F.col(url))).dropDuplicates(["_key"])
    spark = records.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and any(s.getLen() and not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at)):
        old = spark.read.schema(records.schema).json(path).select(normal_url(F.col(url)).alias("_key"))
        new = new.join(old, "_key", "left_anti")
    new.drop("_key").write.mode("append").json(path)
