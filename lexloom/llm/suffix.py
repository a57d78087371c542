"""Repeated strings by fingerprints of a distributed difference-cover sample.

No suffix array is built: nothing recurses, there are no ranks, and suffixes
are not merged.

A difference cover D modulo v holds, for any two positions i and j, a shift
l < v with i+l and j+l both sampled.  So two equal strings of ``length`` bytes
share, at some sampled shift, a prefix of ``length - v + 1`` bytes.

1. *Sort sampled tuples.*  Every sampled position names its prefix tuple by a
   rolling fingerprint; sorted fingerprints of a partition show which names
   are repeated.  (Triples with v = 3 are the same construction; v = 57 keeps
   14 % of the positions instead of 67 %.)
2. *Name what is near a repeated name.*  Only positions within reach of a
   repeated name can start a repeated string.  All of them, sampled or not,
   get the name of their full ``length``-byte prefix, and are sorted again.
3. *Compare adjacent prefixes.*  Equal neighbours in (name, id, position)
   order are repeated strings; all but the first of each are removed.

The suffix order is only needed to a depth of ``length`` bytes, so names of
that depth replace the ranks of a full suffix array.

Edge cases: null texts are empty; texts shorter than ``length`` are kept; an
exact copy of an earlier text is removed whole (if long enough) without
entering the comparison; rows that share an id count as one document, and each
comes out; a null id sorts first; texts are compared as UTF-8 bytes; an empty
table gives no rows.  ``suffix_dedup`` reads only the two named columns, so
others may have any name.  A text is held whole: one of n bytes takes about
90 n bytes of a worker (measured at 8 MB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import repeats as rep
from lexloom.llm import rolling as r

#: Difference covers by modulus (fixed values): every difference modulo v occurs exactly once.
COVERS = {7: (1, 2, 4), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>"


#: Types of the columns of ``documents`` that a pipeline carries through.
CARRIED = {"lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}


def _mend(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The kept bytes without the pieces of characters that an edge cuts in two."""
    head = (data & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    touched = np.zeros(int(char[-1]) + 1, bool)
    touched[char[gone]] = True
    return data[~touched[char]]


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest modulus that leaves sampled prefixes of at least three eighths of the length."""
    v = max((m for m in COVERS if length - m + 1 >= max(1, 3 * length // 8)), default=0)
    return (v, np.array(COVERS[v])) if v else (1, np.array([0]))


def copies(docs: DataFrame, rows: int) -> DataFrame:
    """Ids of documents whose whole text an earlier id has too, from narrow rows only; ``rows`` counts ``docs``."""
    narrow = cluster.cut(docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")), "op8-keys")
    first = cluster.cut(narrow.groupBy("key", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "op8-first")
    return cluster.join_heavy(narrow, first, ["key", "n"], "c", rows).filter("doc_id > first").select("doc_id").distinct()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, removed): the remaining bytes and the removed byte runs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _dedup(rows, [], length)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with repeated strings cut and ``n_chars`` counted anew.

    A character that an edge of a removed run cuts in two goes whole; documents
    of which nothing is left go; those that had no text to begin with stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    found = _dedup(rows, ["lang", "source", "n_chars"], length)
    text = F.decode(F.col("kept"), "UTF-8")
    kept = found.filter("n_removed = 0 OR octet_length(kept) > 0")
    return kept.select("doc_id", F.when(~F.col("was_null"), text).alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def _dedup(docs: DataFrame, carried: list[str], length: int) -> DataFrame:
    """The dedup of (doc_id, text) rows; columns ``carried`` come out beside the result."""
    v, cover = cover_for(length)
    depth = length - v + 1
    total, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = cluster.prime(max(13, total // (8 << 20), n // 20_000))
    sample_parts = cluster.prime(max(13, total * len(cover) // v // rep.PER_PARTITION))
    window_parts = cluster.prime(max(13, total // 4 // rep.PER_PARTITION))
    sample_width, window_width = rep.group_width(sample_parts), rep.group_width(window_parts)

    same = cluster.cut(copies(docs, n), "op8-copies")
    n_same = same.count()
    light = cluster.sized(same, 64, n_same)
    distinct = docs.select("doc_id", "text")
    if n_same:
        distinct = distinct.join(light, "doc_id", "left_anti")

    def sampled(s: r.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Global position, document and sample number of each sampled position with a whole prefix."""
        at, docs_, nums = [], [], []
        sizes = np.diff(s.bounds) - depth + 1
        for k, d in enumerate(cover):
            count = np.maximum((sizes - d + v - 1) // v, 0)
            doc = np.repeat(np.arange(len(sizes)), count)
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at.append(s.bounds[:-1][doc] + turn * v + d)
            docs_.append(doc)
            nums.append(turn * len(cover) + k)
        return np.concatenate(at), np.concatenate(docs_), np.concatenate(nums)

    def names(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent fingerprints of the ``width`` bytes from each position."""
        ends = at + width
        h = r.mix(r.span_sums(r.BYTE_VALUE[data], r.POWERS, at, ends))
        return h, r.mix(r.span_sums(r.BYTE_VALUE2[data], r.POWERS2, at, ends))

    def send_samples(batches):
        out = rep.Sender(sample_parts, hash_bytes=5, both=True, width=sample_width)
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                at, doc, num = sampled(s)
                if len(at):
                    h, p = names(s.data, at, depth)
                    out.add(h, p, s.ids[doc], num)
                    yield from out.rows()
        yield from out.rows(last=True)

    marks = cluster.cut(rep.compare(distinct.mapInArrow(send_samples, rep.ENTRIES_SQL), buckets, sample_parts, both=True, hash_bytes=5), "op8-names")

    def send_windows(rows: pa.Table, found: pa.Table):
        out = rep.Sender(window_parts, width=window_width)
        ids, nums = rep.places(found)
        pieces = []
        for batch in rows.to_batches():
            for s in r.slices(batch, "doc_id", "text"):
                at, docs_ = [], []
                for k, one in enumerate(s.ids):
                    size = int(s.bounds[k + 1] - s.bounds[k])
                    num = rep.of_document(ids, nums, one)
                    if size < length or not len(num):
                        continue
                    p = num // len(cover) * v + cover[num % len(cover)]
                    lo, hi = np.maximum(p - v + 1, 0), np.minimum(p, size - length)
                    ok = lo <= hi
                    step = np.zeros(size + 1, np.int32)
                    np.add.at(step, lo[ok], 1)
                    np.add.at(step, hi[ok] + 1, -1)
                    w = np.flatnonzero(np.cumsum(step[:size]) > 0)
                    at.append(w + s.bounds[k])
                    docs_.append(np.full(len(w), k))
                if at:
                    at, docs_ = np.concatenate(at), np.concatenate(docs_)
                    h, p = names(s.data, at, length)
                    out.add(h, p, s.ids[docs_], at - s.bounds[docs_])
                    pieces += out.rows()
        pieces += out.rows(last=True)
        r.give_back()
        return pa.Table.from_batches(pieces, rep.ENTRIES)

    def dealt(df: DataFrame):
        return df.withColumn("bucket", cluster.id_bucket(F.col("doc_id"), buckets)).groupBy("bucket")

    windows = dealt(distinct).cogroup(marks.groupBy("bucket")).applyInArrow(send_windows, rep.ENTRIES_SQL)
    flags = cluster.cut(rep.compare(windows, buckets, window_parts), "op8-flags")
    cluster.drop(marks)

    def clean(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, offs = rep.places(found)
        whole = rows.column("copy").combine_chunks().to_pylist() if rows.num_rows else []
        out, base = [], 0
        for batch in rows.to_batches():
            for s in r.slices(batch, "doc_id", "text"):
                for k, one in enumerate(s.ids):
                    data = s.data[s.bounds[k] : s.bounds[k + 1]]
                    size = len(data)
                    spans, removed, kept = [], 0, data
                    gone = None
                    if whole[base + s.rows.start + k]:
                        if size >= length:
                            spans, removed, kept = [{"start": 0, "end": size}], size, data[:0]
                    elif len(at := rep.of_document(ids, offs, one)) and len(at := at[at + length <= size]):
                        gone = rep.covered(at, length, size)
                        spans = [{"start": int(a), "end": int(b)} for a, b in r.ranges(gone)]
                        removed, kept = int(gone.sum()), data[~gone]
                    whole_characters = _mend(data, gone) if carried and gone is not None else kept
                    out.append((None if one == np.iinfo(np.int64).min else int(one), size, removed, whole_characters.tobytes(), spans, bool(s.null[k])))
            base += batch.num_rows
        schema = OUT
        if carried:
            schema = schema.append(pa.field("was_null", pa.bool_()))
        cols = [list(x) for x in zip(*out, strict=True)][: len(schema)] if out else [[]] * len(schema)
        found = pa.table(cols, schema=schema)
        for c in carried:
            found = found.append_column(pa.field(c, CARRIED[c]), rows.column(c).cast(CARRIED[c]))
        r.give_back()
        return found

    known = cluster.sized(same.withColumn("copy", F.lit(True)), 64, n_same)
    return dealt(docs.join(known, "doc_id", "left")).cogroup(flags.groupBy("bucket")).applyInArrow(clean, OUT_SQL + (", was_null boolean" if carried else "") + "".join(f", {c} {'long' if c == 'n_chars' else 'string'}" for c in carried))
