"""BM25 and vector search, fusion, dedup and ranking over batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

K1, B, RRF_K = 1.2, 0.75, 60
#: A side is broadcast only when its known rows times an estimate of their width stay below this.
BROADCAST_BYTES = 32 << 20
#: Similarities that a task holds at once.
SCORE_BYTES = 16 << 20


def top_k(hits: DataFrame, k: int, partition: str = "qid") -> DataFrame:
    """The k best rows of each query by (score, id), with rank from 0; the cut stands on the raw row number, so that it is pushed below the sort."""
    w = Window.partitionBy(partition).orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank) by cosine: a stated set of (qid, qv), in blocks of bounded bytes, against all (id, v).

    A block of normalised queries is broadcast as one matrix; every Arrow batch
    of vectors is multiplied with it, some queries at a time, and sends its k
    best rows of each query.
    A zero or null vector has similarity 0 to all; vectors of another length
    than the queries' are an error.
    """
    spark = vectors.sparkSession
    width = queries.agg(F.max(F.size("qv"))).first()[0] or 0
    rows = max(1, BROADCAST_BYTES // (8 * max(1, width)))
    blocks = -(-queries.count() // rows) or 1
    dealt = queries.select("qid", "qv").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    types = dict(vectors.dtypes), dict(queries.dtypes)
    out = None
    for b in range(blocks):
        got = dealt.filter(F.col("block") == b).toArrow()
        held = spark.sparkContext.broadcast((got.column("qid").to_pylist(), _unit_rows(got.column("qv"), width)))

        def go(batches, held=held):
            names, q = held.value
            for batch in batches:
                v, ids = _unit_rows(batch.column("v"), width), batch.column("id").to_numpy(zero_copy_only=False)
                step = max(1, SCORE_BYTES // (8 * max(1, len(v))))
                for lo in range(0, len(names), step):
                    s = v @ q[lo : lo + step].T
                    at = _best(s, ids, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[lo + j] for j in at[1].tolist()], schema.field("qid").type), batch.column("id").take(pa.array(at[0])), pa.array(s[at]),
                    ], names=["qid", "id", "score"])

        schema = pa.schema([got.schema.field("qid")])
        part = top_k(vectors.select("id", "v").mapInArrow(go, f"qid {types[1]['qid']}, id {types[0]['id']}, score double"), k)
        out = part if out is None else out.unionByName(part)
    return out


def _unit_rows(col, width: int) -> np.ndarray:
    """Rows of an Arrow list column as L2-normalised doubles; null and zero rows stay zero."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    out = np.zeros((len(col), width))
    some = np.flatnonzero(np.asarray(col.is_valid()))
    if width and len(some):
        flat = np.asarray(col.drop_null().flatten().to_numpy(zero_copy_only=False), float)
        out[some] = np.nan_to_num(flat.reshape(len(some), -1))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rows of every column by (score to nine places, id)."""
    n, m = s.shape
    if n <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    s = np.round(s, 9)
    least = np.partition(s, n - k, axis=0)[n - k]
    rows, cols = np.nonzero(s >= least)  # ties with the last place too: the global cut decides among them
    order = np.lexsort((ids[rows], -s[rows, cols], cols))
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
    turn = np.arange(len(cols)) - np.repeat(starts, np.diff(np.append(starts, len(cols))))
    return rows[turn < k], cols[turn < k]


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (qid, id, rank) lists with ranks from 0; equal scores keep the order of lists and ranks."""
    every = None
    for source, r in enumerate(ranked):
        part = r.select("qid", "id", "rank", F.lit(source).alias("source"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("source", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "seen.source", "seen.rank", "id")
    return fused.withColumn("rank", F.row_number().over(w) - 1).drop("seen")


def rrf_rank_score(rank: Column, k: int = RRF_K) -> Column:
    """1-based; nothing for null and ranks below 1."""
    return F.when(rank > 0, 1 / (k + rank)).otherwise(0.0)


def merge_hits(*lists: DataFrame, limit: int) -> DataFrame:
    """One row per (qid, id) with the best score, by (score, first seen), ranks anew."""
    every = None
    for source, r in enumerate(lists):
        part = r.select("qid", "id", "score", F.struct(F.lit(source).alias("source"), F.col("rank").alias("at")).alias("seen"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("seen").alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "seen.source", "seen.at", "id")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).withColumn("rank", F.col("rn") - 1).drop("rn", "seen")


def unit_key(doc: Column, article: Column, clause: Column, text: Column) -> Column:
    """Document, article and clause; without these the document and a digest of the text."""
    a, c = F.coalesce(article, F.lit("")), F.coalesce(clause, F.lit(""))
    return F.when((F.coalesce(doc, F.lit("")) != "") & ((a != "") | (c != "")), F.concat(doc, F.lit("|a:"), a, F.lit("|c:"), c)).otherwise(F.concat(F.coalesce(doc, F.lit("")), F.lit("|h:"), T.text_digest(F.coalesce(text, F.lit("")))))


def dedup_units(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First hit of each legal unit in rank order, and the removed ones with reason, key and the chunk that stays."""
    keyed = hits.withColumn("unit_key", unit_key(F.col("doc_id"), F.col("article"), F.col("clause"), F.col("text")))
    first = keyed.groupBy(F.col("qid").alias("_q"), F.col("unit_key").alias("_u")).agg(F.min(F.struct("rank", "id")).alias("_first"))
    same = Window.partitionBy("qid", "unit_key", "rank", "id").orderBy("id")  # repeated rows of one hit: only one stays, and no window holds a whole unit
    marked = (
        keyed.withColumn("_copy", F.row_number().over(same))
        .join(first, F.col("qid").eqNullSafe(F.col("_q")) & F.col("unit_key").eqNullSafe(F.col("_u")))
        .withColumn("_stays", F.col("rank").eqNullSafe(F.col("_first.rank")) & F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("_copy") == 1))
        .withColumn("kept_id", F.col("_first.id")).drop("_q", "_u", "_first", "_copy")
    )
    return marked.filter("_stays").drop("_stays", "kept_id"), marked.filter("NOT _stays").drop("_stays").withColumn("reason", F.lit("duplicate_legal_unit"))


def cutoff(hits: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits of the final cut, and the others with their reason."""
    return hits.filter(F.col("rank") < k), hits.filter(F.col("rank") >= k).withColumn("reason", F.lit("top_k_cutoff"))


def hydrate(hits: DataFrame, chunks: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Chunk columns joined to the final hits, after ranking on narrow rows; Spark's own statistics choose the join."""
    return hits.join(chunks.select(F.col(id_col).alias("id"), *columns), "id")


def margins(hits: DataFrame) -> DataFrame:
    """Per query: the two best scores by rank, their margin, and how many the dominance rule keeps (2 from 1.30 times on, else 3).

    Scores count to nine places, as they do for ranks, so that ties have no margin at all.
    """
    agg = hits.filter("rank < 2").groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 0, F.round("score", 9))).alias("top1"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.round("score", 9))), F.lit(0.0)).alias("top2"),
    )
    return agg.withColumn("margin", F.round(F.col("top1") - F.col("top2"), 9) + 0.0).withColumn("keep", F.when(F.col("top1") >= F.round(1.30 * F.col("top2"), 9), 2).otherwise(3))


def scope_violations(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per query: ids outside the allowed set."""
    return hits.join(allowed.select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("outside"))


def final_positions(final_ids: DataFrame, fused: DataFrame) -> DataFrame:
    """(qid, id, rank, score): ids of an ordered array, rank by position, score 0 where fusion has none."""
    return final_ids.select("qid", F.posexplode("ids").alias("rank", "id")).join(fused.select("qid", "id", "score"), ["qid", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def index_append(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new`` that the index does not hold yet, each key once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
