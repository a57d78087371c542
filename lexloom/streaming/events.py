"""Structured Streaming: event logs, incremental indexes, session state and windowed counts.

The windowed counts are an extension: late events are kept for the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators import index, vectors
from lexloom.sources.versions import Store


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def log_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only event log as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def incremental_index(docs: DataFrame, path: str, checkpoint: str, name: str = "stream", id_col: str = "doc_id", fields: dict[str, str] | None = None) -> StreamingQuery:
    """Every micro-batch appends its documents to the BM25 index at ``path``, which the first one builds; a replayed batch adds nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        if Store(batch.sparkSession, path).manifest() is None:
            index.build(batch, path, id_col, fields, batch=(name, epoch))
        else:
            index.append(batch, path, batch=(name, epoch))

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_vectors(rows: DataFrame, path: str, checkpoint: str, name: str = "stream", id_col: str = "id", vector_col: str = "v") -> StreamingQuery:
    """Every micro-batch puts its vectors into the lists of the index at ``path``, which must be there; a replayed batch adds nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        vectors.append(batch, path, id_col, vector_col, batch=(name, epoch))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_history(turns: DataFrame, last: int = 5) -> DataFrame:
    """(conv_id, seen, history): the last messages of each session, kept as state across batches."""

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        for pdf in batches:
            rows = pdf.sort_values("turn")
            kept = (kept + rows["text"].fillna("").tolist())[-last:]
            seen += len(rows)
        state.update((seen, kept))
        yield pd.DataFrame({"conv_id": [key[0]], "seen": [seen], "history": [kept]})

    return turns.groupBy("conv_id").applyInPandasWithState(go, "conv_id long, seen long, history array<string>", "seen long, kept array<string>", "update", GroupStateTimeout.NoTimeout)


def done_tasks(log: DataFrame) -> DataFrame:
    """Tasks whose last status is success: what a resumed run may skip."""
    return log.groupBy("task").agg(F.max_by("status", "seq").alias("status")).filter("status = 'success'").select("task")
