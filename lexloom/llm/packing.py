"""Packing by optimal length buckets.

The global histogram of token counts goes through a dynamic programme that
chooses at most ``buckets`` bucket bounds so that padding every document to
its bucket's bound costs the fewest tokens in all.  Inside a bucket, documents
form batches of at most ``token_budget`` padded tokens (a document longer than
the budget is a batch of its own).

The histogram has a row for each distinct length, and all of them take part
however many there are; ``max_lengths`` is accepted for old callers and changes
nothing.  The programme keeps 8 bytes for each distinct length and bucket.

Edge cases: null and empty texts have no tokens and go to the first bucket;
equal lengths share a bucket; an empty table gives no rows; repeated rows are
packed each; a null id comes first in its bucket.  Only the two named columns
are read, so others may have any name.  A text is held whole by the JVM, nowhere
else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (all among ``lengths``, ascending) of least total padding.

    The cost of a bucket obeys the quadrangle inequality, so each row of the
    programme is filled by divide and conquer over its monotone choices, one
    level of the recursion at a time.
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.int64)
    ends = lengths.astype(np.int64)

    def cost(a: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ends[j] * (c[j + 1] - c[a]) - (tokens[j + 1] - tokens[a])

    def fill(j: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Best starts of the ends ``j``, each among ``a`` to ``b``; the first of equal ones."""
        size = b - a + 1
        heads = np.cumsum(size) - size
        starts = np.arange(size.sum()) + np.repeat(a - heads, size)
        total = np.where(starts > 0, best[starts - 1], 0) + cost(starts, np.repeat(j, size))
        least = np.minimum.reduceat(total, heads)
        hits = np.flatnonzero(total == np.repeat(least, size))
        new[j], pick[j] = least, starts[hits[np.searchsorted(hits, heads)]]

    every = np.arange(n)
    best = cost(np.zeros(n, np.int64), every)
    choice = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, pick = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            fill(j, a, np.minimum(b, j))
            k = pick[j]
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        best = new
        choice.append(pick)
    bounds, j = [], n - 1
    for pick in reversed(choice):
        bounds.append(int(lengths[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def token_count(text: F.Column) -> F.Column:
    """Words between spaces of the ASCII kind, as tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, token_budget: int = 65_536, max_lengths: int = 20_000, tokens: F.Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, padding, batch, place): batches are numbered within a bucket, places within a batch."""
    count = token_count(F.col(text_col)) if tokens is None else tokens
    rows = cluster.cut(docs.select(F.col(id_col).alias("doc_id"), count.alias("n_tokens")), "op4-rows")
    hist = rows.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    bounds = optimal_bounds(hist.column("n_tokens").to_numpy(), hist.column("count").to_numpy(), buckets)
    steps = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(steps, lambda b: b < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_length", F.element_at(steps, F.col("bucket") + 1))
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return cluster.numbered(placed, "bucket", "doc_id", "_n").select(
        "doc_id", "n_tokens", "bucket", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("_n") / per).cast("long").alias("batch"), (F.col("_n") % per).cast("long").alias("place"),
    )
