"""Corpus pipeline: five operators in turn over whole tables, each stage written and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import cluster, decontaminate, jaccard, packing, quality, suffix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker predicts as label 1; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.learn(docs.select("doc_id", "text"), labels)).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate component, once: of rows that share an id the least stays; rows without an id all stay."""
    found = jaccard.jaccard_components(docs)
    rest = cluster.cut(found.filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-near")
    kept = docs.join(cluster.sized(rest, 64), "doc_id", "left_anti").select(*COLUMNS)
    twice = cluster.cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-twice")
    n = twice.count()
    if not n:
        return kept
    few = cluster.sized(twice, 64, n)
    once = kept.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(few, "doc_id", "left_anti").unionByName(once)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte runs that start earlier; characters cut in two at an edge go, emptied documents too."""
    return suffix.without_repeats(docs, length=100).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth lies in benchmark windows go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = cluster.cut(found.filter(decontaminate.contaminated()).select("doc_id").distinct(), "pipeline-contaminated")
    return docs.join(cluster.sized(bad, 64), "doc_id", "left_anti").select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's bucket, batch and place."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: SQL cannot express the learned ranker nor the bucket programme; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        kept = cluster.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            cluster.drop(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
