"""Substring dedup by Rabin-Karp hashes of every fixed-length token window.

Each window of ``window`` words of a document gets a rolling 64-bit hash; a
second, independent hash deals windows to partitions, so that equality is
decided on 64 bits plus the partition's.  Spark counts the hashes; every
occurrence but the first in (id, position) order is repeated, and overlapping
repeated windows merge into maximal removal intervals.

Edge cases: a null or empty text has no words and nothing is removed; texts
shorter than a window are kept; rows that share an id count as one document
for removal and each is returned, repeated rows too; a null id sorts first; an
empty table gives no rows.  Only the two named columns are read, so others may
have any name.  A text is held whole: one of n bytes takes about 50 n bytes of
a worker (measured at 8 MB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import repeats as rep
from lexloom.llm import rolling as r

OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
OUT_SQL = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def plan_sizes(docs: DataFrame, text_col: str, unit_bytes: float) -> tuple[int, int]:
    """Hash partitions and document buckets that bound what one task holds."""
    total, n = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count(F.lit(1))).first()
    return cluster.prime(max(13, int(total / unit_bytes) // rep.PER_PARTITION)), cluster.prime(max(13, total // (8 << 20), n // 20_000))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): kept words joined by one space, removed word intervals."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts, buckets = plan_sizes(docs, "text", 6.0)
    width = rep.group_width(parts)

    def send(batches):
        out = rep.Sender(parts, width=width)
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                starts, ends, bounds = r.words(s, r.NOT_SPACE)
                if len(starts) < window:
                    continue
                w = r.word_hashes(s.data, starts, ends)
                at, doc, offset = r.valid_windows(bounds, window)
                h = r.mix(r.window_sums(w, window, r.POWERS))[at]
                p = r.mix(r.window_sums(r.mix(w), window, r.POWERS2))[at]
                out.add(h, p, s.ids[doc], offset)
                yield from out.rows()
        yield from out.rows(last=True)

    flags = cluster.cut(rep.compare(docs.mapInArrow(send, rep.ENTRIES_SQL), buckets, parts), "op3-flags")

    def clean(rows: pa.Table, marks: pa.Table) -> pa.Table:
        ids, offs = rep.places(marks)
        parts = [_cleaned(s, ids, offs, window) for batch in rows.to_batches() for s in r.slices(batch, "doc_id", "text")]
        r.give_back()
        return pa.Table.from_batches(parts, OUT)

    dealt = docs.withColumn("bucket", cluster.id_bucket(F.col("doc_id"), buckets))
    return dealt.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(clean, OUT_SQL)


def _cleaned(s: r.Slice, ids: np.ndarray, offs: np.ndarray, window: int) -> pa.RecordBatch:
    """The result of a slice of documents as Arrow buffers, from the sorted places of repeated windows."""
    starts, ends, bounds = r.words(s, r.NOT_SPACE)
    n = np.diff(bounds)
    a, b = np.searchsorted(ids, s.ids, "left"), np.searchsorted(ids, s.ids, "right")
    doc = np.repeat(np.arange(len(n)), b - a)
    off = offs[np.arange(len(doc)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
    ok = off + window <= n[doc]
    gone = rep.covered(bounds[doc[ok]] + off[ok], window, len(starts))
    before = np.append(0, np.cumsum(gone))
    # A run of removed words ends with its document.
    edge = np.zeros(len(starts) + 1, bool)
    edge[bounds] = True
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1] | edge[1:-1]
    closes[:-1] &= ~gone[1:] | edge[1:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    base = bounds[np.searchsorted(bounds, first, "right") - 1] if len(first) else first
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, bounds), pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], names=["start", "end"]))
    # Kept words with a space after each, then without the last space of every document.
    keep = np.flatnonzero(~gone)
    size = (ends - starts)[keep]
    to = np.cumsum(size + 1) - (size + 1)
    data = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[at + np.repeat(to, size)] = s.data[at + np.repeat(starts[keep], size)]
    many = np.searchsorted(keep, bounds)
    full = np.append(to, len(data))[many]
    some = np.flatnonzero(np.diff(many))
    stays = np.ones(len(data), bool)
    stays[full[some + 1] - 1] = False
    ends_at = np.append(0, np.cumsum(np.diff(full) - (np.diff(many) > 0)))
    text = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends_at.astype(np.int32)), pa.py_buffer(data[stays]))
    return pa.RecordBatch.from_arrays([pa.array(s.ids, mask=s.ids == np.iinfo(np.int64).min), pa.array(n.astype(np.int64)), pa.array(before[bounds[1:]] - before[bounds[:-1]]), text, spans], schema=OUT)
