"""Find repeated hash windows across a corpus: the part that substring and suffix-array dedup share.

Mappers send each window hash once per chunk, packed in sorted blobs to hash
partitions of bounded size; a partition compares what it got and answers with
the places that are repeated, addressed to buckets of documents.  A hot window
costs one entry per chunk, however many rows hold it.

A chunk is cut into at most ``FAN`` blobs, so that a blob keeps some hundred
entries however large the input is.  With more partitions than that, chunks go
to groups of partitions first, and a second exchange deals the groups out; both
move a number of bytes in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import rolling as r

#: Entries that a mapper gathers before it sorts and sends them; entries that one hash partition should get.
CHUNK, PER_PARTITION = 1_000_000, 1_000_000
#: Blobs that a chunk is cut into at most.
FAN = 4096
#: Known places that go to one partition together.
KNOWN = 50_000

ENTRIES = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("blob", pa.binary())])
FLAGS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
ENTRIES_SQL, FLAGS_SQL = "part int, known boolean, blob binary", "bucket int, blob binary"


def group_width(parts: int) -> int:
    """Partitions of a group, 1 where they need no groups."""
    return -(-parts // FAN)


class Sender:
    """Collects (hash, partition, id, offset) entries and yields packed rows for partitions, or for groups of ``width`` partitions.

    An entry of a group carries its partition's number there in its offset.
    """

    def __init__(self, parts: int, hash_bytes: int = 8, both: bool = False, merge: bool = True, width: int = 1):
        self.parts, self.hash_bytes, self.both, self.merge, self.held, self.n = parts, hash_bytes, both, merge, [], 0
        self.width = width

    def add(self, h: np.ndarray, partition_hash: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.put(h, ((partition_hash >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int32), ids, offsets)

    def put(self, *entry: np.ndarray) -> None:
        self.held.append(entry)
        self.n += len(entry[0])

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.n or not (last or self.n >= CHUNK):
            return
        h, p, ids, off = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        if self.hash_bytes < 8:
            h &= ~np.uint64((1 << (64 - 8 * self.hash_bytes)) - 1)
        order = np.lexsort((h, p))
        h = h[order]
        p = p[order]
        ids = ids[order]
        off = off[order]
        del order
        same = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        send = np.ones(len(h), bool)
        if self.merge and same.any():
            group = np.zeros(len(h), np.int64)
            np.cumsum(~same, out=group[1:])
            many = np.zeros(len(h), bool)
            many[1:] |= same
            many[:-1] |= same
            sub = np.flatnonzero(many)
            sub = sub[np.lexsort((off[sub], ids[sub], group[sub]))]
            head = np.ones(len(sub), bool)
            head[1:] = group[sub][1:] != group[sub][:-1]
            send[sub[~head]] = False
            flagged = sub if self.both else sub[r.after_head(head, ids[sub], off[sub])]
            flagged = flagged[np.lexsort((off[flagged], ids[flagged]))]
            for k in range(0, len(flagged), KNOWN):  # known places go to any partition, evenly: in pieces, so that none gets many
                some = flagged[k : k + KNOWN]
                part = int(r.mix(h[some[:1]] ^ np.uint64(k))[0] % np.uint64(self.parts))
                yield pa.record_batch([[part], [True], [r.pack(None, ids[some], off[some])]], schema=ENTRIES)
        h, p, ids, off = h[send], p[send], ids[send], off[send]
        if self.width > 1:
            off = off * self.width + p % self.width
            p = p // self.width
            order = np.argsort(p * np.int64(1 << 16) + (h >> np.uint64(48)).astype(np.int64), kind="stable")  # blobs need only the upper bits in order
            h, p, ids, off = h[order], p[order], ids[order], off[order]
        starts, sizes = r.runs(p)
        blobs = [r.pack(h[a : a + n], ids[a : a + n], off[a : a + n], self.hash_bytes) for a, n in zip(starts, sizes, strict=True)]
        out = pa.record_batch([pa.array(p[starts], pa.int32()), pa.array([False] * len(blobs)), pa.array(blobs, pa.binary())], schema=ENTRIES)
        del h, p, ids, off, send, blobs
        r.give_back()
        yield out


def regrouped(entries: DataFrame, parts: int, **sender) -> DataFrame:
    """The entries of groups of partitions dealt to their partitions, chunk by chunk; as they are if there are no groups."""
    width = group_width(parts)
    if width == 1:
        return entries

    def go(batches):
        out = Sender(parts, **sender)
        for batch in batches:
            for part, known, blob in zip(batch.column("part").to_pylist(), batch.column("known").to_pylist(), batch.column("blob"), strict=True):
                if known:
                    yield pa.record_batch([[part], [True], [blob.as_py()]], schema=ENTRIES)
                    continue
                h, i, o = r.unpack(blob.as_buffer())
                out.put(h, (part * width + o % width).astype(np.int32), i, o // width)
                yield from out.rows()
        yield from out.rows(last=True)

    return entries.repartition("part").mapInArrow(go, ENTRIES_SQL)


def compare(entries: DataFrame, buckets: int, parts: int, both: bool = False, hash_bytes: int = 8) -> DataFrame:
    """Rows (bucket, blob) of the repeated places: all but the first of each hash, or with ``both`` the first too."""

    def answer(table: pa.Table) -> pa.Table:
        ids, offs, hashes = [], [], []
        out_ids, out_offs = [], []
        r.give_back()
        for known, blob in zip(table.column("known").to_pylist(), table.column("blob"), strict=True):
            h, i, o = r.unpack(blob.as_buffer())
            if known:
                out_ids.append(i)
                out_offs.append(o)
            else:
                hashes.append(h)
                ids.append(i)
                offs.append(o)
        if hashes:
            h, i, o = np.concatenate(hashes), np.concatenate(ids), np.concatenate(offs)
            hashes, ids, offs = [], [], []
            first, rest = r.repeated(h, i, o)
            for at in (first, rest) if both else (rest,):
                out_ids.append(i[at])
                out_offs.append(o[at])
            del h, first, rest
        i, o = np.concatenate([np.zeros(0, np.int64), *out_ids]), np.concatenate([np.zeros(0, np.int64), *out_offs])
        b = np.mod(i, buckets)
        order = np.lexsort((o, i, b))
        i, o, b = i[order], o[order], b[order]
        starts, sizes = r.runs(b)
        blobs = [r.pack(None, i[a : a + n], o[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
        del i, o, order, out_ids, out_offs
        r.give_back()
        return pa.table([pa.array(b[starts], pa.int32()), pa.array(blobs, pa.binary())], schema=FLAGS)

    return regrouped(entries, parts, both=both, hash_bytes=hash_bytes).groupBy("part").applyInArrow(answer, FLAGS_SQL)


def places(flags: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The (id, offset) places of a bucket, sorted."""
    got = [r.unpack(x.as_buffer())[1:] for x in flags.column("blob")]
    i = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in got)])
    o = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in got)])
    order = np.lexsort((o, i))
    return i[order], o[order]


def of_document(ids: np.ndarray, offs: np.ndarray, one: int) -> np.ndarray:
    """The sorted offsets of one document among sorted places."""
    a, b = np.searchsorted(ids, one, "left"), np.searchsorted(ids, one, "right")
    return offs[a:b]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window of ``width`` units from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
