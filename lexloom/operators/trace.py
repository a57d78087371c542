"""Trace tables: upserts by key, stage hits, details and recent runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key, the new value first; for ``keep_old`` columns only a new value that is not null replaces. Columns of either side may be missing."""
    n = new.withColumn("_new", F.lit(True))
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    j = old.alias("o").join(n.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def pick(c: str) -> Column:
        a = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        b = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == key or c in keep_old or c not in new.columns:
            return F.coalesce(b, a)
        return F.when(F.col("n._new"), b).otherwise(a)

    return j.select(*(pick(c).alias(c) for c in columns))


def latest(events: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def recent(runs: DataFrame, n: int, order: str = "started_at", tie: str = "trace_id") -> DataFrame:
    """The last runs, between 1 and 500 of them."""
    return runs.orderBy(F.desc(order), tie).limit(max(1, min(n, 500)))


def stage_hits(stages: dict[str, DataFrame]) -> DataFrame:
    """One table of the hits of all stages; columns that a stage lacks are null."""
    parts = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def detail(runs: DataFrame, events: DataFrame, hits: DataFrame) -> DataFrame:
    """A run with its events by id and its hits by stage and rank."""
    e = events.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "stage", "payload"))).alias("events"))
    h = hits.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("stage", "rank", "chunk_id", "score"))).alias("hits"))
    return runs.join(e, "trace_id", "left").join(h, "trace_id", "left")


def history(turns: DataFrame, last: int = 10) -> DataFrame:
    """The last messages of each session."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last).drop("_n")


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("turns"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """Numbered context headers (title of at most 80 characters) and texts of a query's hits by rank, joined."""
    head = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.substring("title", 1, 80), F.lit("\n"), F.col("text"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """The first hit of each document."""
    w = Window.partitionBy("qid", "doc_id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
