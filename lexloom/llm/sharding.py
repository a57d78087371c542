"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups are rows of equal text; every one of them is an item.  The driver holds
the histogram of group sizes only (16 bytes for each distinct size) and deals
the sizes, largest first, to the least-loaded shard through a heap.  Many items
of one size are dealt at once: together they take the least of the loads that
each shard would show after none, one, two ... more of them.  Spark numbers the
groups of each size, and the number says the shard.

Edge cases: null texts count no bytes and group with empty ones; rows of one
group land in one shard, whatever their number; equal sizes are told apart by
the digest of the text; a null id is a row like any other and comes first in
its shard; repeated rows are rows; an empty table gives no rows.  Only the two
named columns are read, so others may have any name.  A text is held whole by
the JVM, nowhere else.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster

ROW_BYTES = 16


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, shards, ends): of ``counts`` items of each size, numbers below the first end go to the first shard, and so on.

    Longest first to the least-loaded shard; ties by shard.
    """
    load = [(0, s) for s in range(shards)]
    out = []
    for k in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[k]), int(counts[k])
        got = [0] * shards
        if left > 4 * shards and size:
            loads = np.array([x for x, _ in sorted(load, key=lambda x: x[1])])

            def taken(level: int, loads=loads, size=size) -> np.ndarray:
                """Items that each shard takes while its load is below ``level``."""
                return np.maximum(-((loads - level) // size), 0)

            lo, hi = int(loads.min()), int(loads.max()) + size * (left // shards + 1)
            while hi - lo > 1:  # the highest level that does not deal more than there are
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if taken(mid).sum() <= left else (lo, mid)
            some = taken(lo)
            got, left = some.tolist(), left - int(some.sum())
            load = [(int(x + size * n), s) for s, (x, n) in enumerate(zip(loads, some, strict=True))]
            heapq.heapify(load)
        for _ in range(left):
            total, shard = load[0]
            got[shard] += 1
            heapq.heapreplace(load, (total + size, shard))
        used = [s for s in range(shards) if got[s]]
        out.append((size, used, np.cumsum([got[s] for s in used]).tolist()))
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): whole groups in shards of near equal bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cluster.cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"),
    ), "op6-rows")
    groups = cluster.cut(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).select("key", "size", "n", (F.col("n") * F.col("size")).alias("bytes")), "op6-groups")
    hist = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).toArrow()
    total = int(np.sum(hist.column("n").to_numpy()))
    plan = schedule(hist.column("bytes").to_numpy(), hist.column("c").to_numpy(), shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "bytes long, shards array<int>, ends array<long>")
    dealt = cluster.numbered(groups, "bytes", "key", "_n").join(cluster.sized(table, 64 + 12 * min(shards, 8), len(plan)), "bytes")
    turn = F.size(F.filter("ends", lambda e: e <= F.col("_n"))) + 1
    placed = cluster.cut(dealt.select("key", "size", "n", F.element_at("shards", turn).alias("shard")), "op6-shards")
    where = cluster.cut(cluster.join_heavy(rows, placed, ["key", "size"], "n", total).select("doc_id", "size", "text_crc32", "shard"), "op6-placed")
    cluster.drop(rows, groups, placed)
    return cluster.numbered(where, "shard", "doc_id", "slot")
