"""Vectorised words, rolling hashes and hash runs over Arrow string batches.

Everything works on UTF-8 bytes and numpy arrays, a bounded slice of documents
at a time, so memory follows the slice and never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SLICE_BYTES = 1 << 18

_rng = np.random.default_rng(20240613)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Space characters 0x20 and 0x09-0x0D end a word; every other byte is part of one.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            out = []
            for b in (self.base, self.inverse):
                p = np.full(self.n, b, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS, POWERS2 = Powers(BASE), Powers(BASE2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_sums(values: np.ndarray, powers: Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[starts:ends]`` for each span, by prefix sums."""
    up, down = powers.upto(len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=c[1:])
    return (c[ends] - c[starts]) * down[starts]


def window_sums(values: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of each run of ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=c[1:])
    return (c[k:] - c[:n]) * down[:n]


@dataclass
class Slice:
    """Some documents of a batch: ids, the joined bytes, and document bounds."""

    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    rows: slice
    null: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null rows come out empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch | pa.Table, id_col: str, text_col: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into runs of whole documents of about ``limit`` bytes."""
    n = batch.num_rows
    if n == 0:
        return
    text = batch.column(text_col)
    raw, off = string_parts(text)
    ids = np.asarray(batch.column(id_col).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(id_col).combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), np.int64)
    null = np.asarray(text.is_null().to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else text.combine_chunks().is_null().to_numpy(zero_copy_only=False), bool)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Slice(ids[at:to], raw[off[at] : off[to]], off[at : to + 1] - off[at], slice(at, to), null[at:to])
        at = to


def words(s: Slice, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and where each document's words begin."""
    m = member[s.data]
    n = len(m)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(s.ids) + 1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[s.bounds] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | cut[1:n]
    last[:-1] &= ~m[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, s.bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mix(span_sums(BYTE_VALUE[data], POWERS, starts, ends) ^ (ends - starts).astype(np.uint64))


def valid_windows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each length-``k`` window inside one document, its document, its offset there."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][doc] + offset, doc, offset


CODEC = pa.Codec("zstd", compression_level=1)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of ``x``, one plane after another, entropy-coded."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    packed = CODEC.compress(raw, asbytes=True)
    return np.array([width, len(packed)], np.int64).tobytes() + packed


def _unplanes(buf: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    width, size = np.frombuffer(buf, np.int64, 2, at)
    raw = CODEC.decompress(buf[at + 16 : at + 16 + size], int(width) * n, asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + 16 + int(size)


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def pack(hashes: np.ndarray | None, ids: np.ndarray, offsets: np.ndarray, hash_bytes: int = 8) -> bytes:
    """Encode (hash, id, offset) entries; with hashes they must be sorted by hash.

    Sorted hashes keep their upper 16 bits as small differences, ids are stored
    from the smallest, and all but the lower hash bytes are entropy-coded, which
    makes about 9 bytes of an entry of 20.
    """
    n = len(ids)
    base = int(ids.min()) if n else 0
    wide = (ids - base).astype(np.uint64)
    some, turn = np.unique(wide, return_inverse=True) if n else (wide, wide)
    listed = len(some) if 4 * len(some) < n else 0  # few ids: a list of them, and places in it
    if listed:
        body = _planes(np.diff(some, prepend=np.uint64(0)), 8) + _planes(turn.astype(np.uint64), _width(turn))
    else:
        body = _planes(wide, _width(wide))
    head = np.array([n, base, hash_bytes if hashes is not None else 0, listed], np.int64).tobytes()
    body += _planes(offsets.astype(np.uint64), _width(offsets))
    if hashes is not None:
        top = (hashes >> np.uint64(48)).astype(np.uint64)
        body += _planes(np.diff(top, prepend=np.uint64(0)), 2)
        be = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:hash_bytes]
        body += np.ascontiguousarray(be).tobytes()
    return head + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = memoryview(blob)
    n, base, hash_bytes, listed = (int(x) for x in np.frombuffer(buf, np.int64, 4, 0))
    at = 32
    if listed:
        some, at = _unplanes(buf, at, listed)
        turn, at = _unplanes(buf, at, n)
        ids = np.cumsum(some)[turn]
    else:
        ids, at = _unplanes(buf, at, n)
    offsets, at = _unplanes(buf, at, n)
    hashes = np.zeros(n, np.uint64)
    if hash_bytes:
        top, at = _unplanes(buf, at, n)
        be = np.zeros((n, 8), np.uint8)
        be[:, 2:hash_bytes] = np.frombuffer(buf, np.uint8, n * (hash_bytes - 2), at).reshape(n, hash_bytes - 2)
        hashes = be.reshape(-1).view(">u8").astype(np.uint64) | (np.cumsum(top) << np.uint64(48))
    return hashes, ids.astype(np.int64) + base, offsets.astype(np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours in a sorted array."""
    if len(keys) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def repeated(hashes: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of entries whose hash occurs more than once: the first by (id, offset) of each hash, and the others."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    sub = order[many]
    sub = sub[np.lexsort((offsets[sub], ids[sub], hashes[sub]))]
    head = np.ones(len(sub), bool)
    head[1:] = hashes[sub][1:] != hashes[sub][:-1]
    return sub[head], sub[after_head(head, ids[sub], offsets[sub])]


def after_head(head: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entries of sorted runs at another place than their run's head: a repeated row is no repeat of itself."""
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    return ~head & ((ids != ids[first]) | (offsets != offsets[first]))


def ranges(keep: np.ndarray) -> np.ndarray:
    """(start, end) rows of the maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and an executor's limit holds for all of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
