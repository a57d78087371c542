"""Registered queries on stored indexes: named batches, streams, and vector lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators import index as IX
from lexloom.operators import vectors as VX
from lexloom.plans.catalog import DUCK_WORD, VEC_SQL, t, texts, vector_hits
from lexloom.plans.registry import query
from lexloom.sources.shared import kept, shared_dir
from lexloom.streaming import events

INDEX_SQL = f"""WITH po AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, (SELECT count(*) FROM documents) AS n FROM po GROUP BY term"""


def _terms(ix):
    """(term, df, cf, n): document frequencies as the index adds them up, occurrences from its postings."""
    df = ix.terms.groupBy("term").agg(F.sum("df").alias("df"))
    cf = ix.postings.groupBy("term").agg(F.sum("tf").alias("cf"))
    return df.join(cf, "term").crossJoin(F.broadcast(ix.totals.agg(F.sum("n").alias("n"))))  # one row


@query("index_batches", INDEX_SQL)
def index_batches(spark, d):
    """The documents in four named batches, every one of them twice, then merged: the index of one build."""
    docs = texts(spark, d).select("doc_id", "text")

    def grow(path):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
        IX.build(docs.filter(part == 0), path, batch=("load", 0))
        for k in (1, 1, 2, 3, 3, 2):
            IX.append(docs.filter(part == k), path, batch=("load", k))
        IX.merge(spark, path)

    return _terms(IX.read(spark, kept(spark, "bm25-batches", f"{d}/documents.parquet", grow)))


@query("index_stream", INDEX_SQL)
def index_stream(spark, d):
    """The documents as a stream into an index, and the same stream again from its first batch: nothing counts twice."""
    source = f"{d}/documents.parquet"
    schema = t(spark, d, "documents").schema

    def grow(path):
        folder, _, name = source.rpartition("/")
        for _ in range(2):  # a new checkpoint: every batch comes again under its own number
            stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
            rows = stream.option("recursiveFileLookup", "true").parquet(f"{folder}/{name[:-8]}[.]parquet").select("doc_id", "text")
            events.incremental_index(rows, path, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()

    return _terms(IX.read(spark, kept(spark, "bm25-stream", source, grow)))


def vector_index(spark, d):
    """The stored index of the embeddings: half of them build it, all of them are appended."""
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))

    def grow(path):
        VX.build(rows.filter("id % 2 = 0"), path, batch=("load", 0))
        VX.append(rows, path, batch=("load", 1))

    return VX.read(spark, kept(spark, "vectors", f"{d}/embeddings.parquet", grow))


def _asked(spark, d):
    return t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


@query("vector_index_topk")
def vector_index_topk(spark, d):
    """Every fiftieth vector against all rows, by the lists of its nearest centroids; what is missed, ``vector_index_recall`` counts."""
    ix = vector_index(spark, d)
    return VX.search(ix, _asked(spark, d), 10, VX.probes_of(ix)).select("qid", "id", F.round("score", 4).alias("score"), "rank")


@query("vector_index_recall")
def vector_index_recall(spark, d):
    """(qid, found, expected) of the indexed search against the exact one."""
    ix = vector_index(spark, d)
    return VX.recall(VX.search(ix, _asked(spark, d), 10, VX.probes_of(ix)), vector_hits(spark, d, 10))


@query("vector_index_exact", VEC_SQL + " SELECT qid, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM rv WHERE rank < 10")
def vector_index_exact(spark, d):
    """The stated fallback: with every list probed the index gives the exact hits."""
    ix = vector_index(spark, d)
    return VX.search(ix, _asked(spark, d), 10, ix.config["lists"] or 1).select("qid", "id", F.round("score", 4).alias("score"), "rank")
