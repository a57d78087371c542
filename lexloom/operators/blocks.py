"""Numpy inside a task: counts of the terms of documents, and scores of all queries of a batch over a block of documents.

Spark deals the postings of the queries' terms to blocks by document; a block
is one partition of bounded postings.  There is no row for each query, term and
document: terms that many queries and documents share are one matrix product,
the others are added up from their own postings.  Only the best rows of every
query leave the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.operators.retrieval import K1, B

#: Bytes of the dense terms of a block, and of the scores of the queries that are scored at once.
DENSE_BYTES, SCORE_BYTES = 64 << 20, 16 << 20
#: A term is dense if this share of all pairs of query and document has it.
DENSE_SHARE = 0.01
#: Documents that share a maximum.
GROUP = 32
#: Queries whose hits go out in one batch.
OUT = 4096
#: Tokens that are counted at once, but for the last texts', and bytes of texts that are cut into words at once; a longer one is cut whole.
TOKENS, TEXT_BYTES = 1 << 22, 8 << 20
#: First bytes of the characters of :data:`lexloom.functions.text.WORD` in UTF-8: digits, Latin letters, U+00C0 to U+0FFF; U+1000 on by their next bytes.
WORD_BYTES = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0xC3, 0xE1)])
#: Postings of a batch of lists that leaves a task, and of a list from which the next one of its term is another.
SENT = 1 << 18


def count_terms(batches: Iterator[pa.RecordBatch], sent: int | None = None) -> Iterator[pa.RecordBatch]:
    """(term, field, n, cf, id, tf, len): one row for each field and distinct token of some rows (id, field, text), with lists of the ids, counts and lengths of the n rows that have it.

    Rows are counted at once whatever batches they come in, up to TOKENS tokens; they go out in batches of ``sent`` postings.
    """
    sent = sent or SENT
    rows, lengths, words, held = [], [], [], 0
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXT_BYTES, side="right")))
            found, n = _words(text.slice(lo, hi - lo))
            rows.append(batch.slice(lo, hi - lo).select(["id", "field"]))
            lengths.append(n)
            words.append(found)
            held, lo = held + len(found), hi
            if held >= TOKENS:
                yield from _counts(pa.Table.from_batches(rows), np.concatenate(lengths), pa.chunked_array(words), sent)
                rows, lengths, words, held = [], [], [], 0
    if held:
        yield from _counts(pa.Table.from_batches(rows), np.concatenate(lengths), pa.chunked_array(words), sent)


def _words(text: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """The matches of :data:`lexloom.functions.text.WORD` in all texts, and the number of each text's."""
    text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(text), np.int32)
    mine = WORD_BYTES[raw]
    three = np.flatnonzero(raw == 0xE1)  # U+1000 to U+1FFF: the class ends at U+1EF9
    mine[three] = (raw[three + 1] < 0xBB) | ((raw[three + 1] == 0xBB) & (raw[three + 2] <= 0xB9))
    more = np.flatnonzero((raw & 0xC0) == 0x80)
    for _ in range(3):  # a character's other bytes are as its first
        mine[more] = mine[more - 1]
    first, last = mine.copy(), mine.copy()
    first[1:] &= ~mine[:-1]
    last[:-1] &= ~mine[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]  # no word goes on into the next text
    first[edge], last[edge - 1] = mine[edge], mine[edge - 1]
    first = np.flatnonzero(first)
    cuts = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - first)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(raw[mine]))
    return found, np.diff(np.searchsorted(first, offsets)).astype(np.int32)


def _counts(rows: pa.Table, n: np.ndarray, words: pa.ChunkedArray, sent: int) -> Iterator[pa.RecordBatch]:
    many, coded = len(n), words.combine_chunks().dictionary_encode()
    field = rows.column("field").combine_chunks().dictionary_encode()
    fields = len(field.dictionary)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (key * fields + np.repeat(field.indices.to_numpy(zero_copy_only=False), n)) * many + np.repeat(np.arange(many), n)
    key, tf = np.unique(key, return_counts=True)
    group, row = np.divmod(key, many)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    term, kind = np.divmod(group[starts], fields)
    terms, ids = coded.dictionary, rows.column("id").combine_chunks()
    cf = np.add.reduceat(tf, starts).astype(np.int64)
    return _lists(
        lambda x: [terms.take(pa.array(term[x])), field.dictionary.take(pa.array(kind[x]))], np.append(starts, len(group)), cf,
        lambda x: [ids.take(pa.array(row[x])), pa.array(tf[x].astype(np.int32)), pa.array(n[row[x]])], sent,
    )


def _lists(keys: Callable[[slice], list], cuts: np.ndarray, cf: np.ndarray, posts: Callable[[slice], list], sent: int) -> Iterator[pa.RecordBatch]:
    """(term, field, n, cf, id, tf, len) of lists that end at ``cuts`` of the postings, in batches of ``sent`` postings."""
    lo = 0
    while lo < len(cf):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + sent, side="right")) - 1)
        ends = pa.array((cuts[lo : hi + 1] - cuts[lo]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in posts(slice(cuts[lo], cuts[hi]))]
        yield pa.RecordBatch.from_arrays([*keys(slice(lo, hi)), pa.array(np.diff(cuts[lo : hi + 1])), pa.array(cf[lo:hi]), *lists], names=["term", "field", "n", "cf", "id", "tf", "len"])
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], parts: int, share: float, over: int) -> Iterator[pa.RecordBatch]:
    """(part, posts): the lists of :func:`count_terms` by a hash of the term, a piece for each part and rows that are counted at once.

    A list of more than ``share`` of these rows goes to one of ``over`` parts.
    """
    for lists in count_terms(batches, 1 << 62):
        part = np.fromiter(map(zlib.crc32, lists.column("term").cast(pa.binary()).to_pylist()), np.int64, lists.num_rows)
        if over > 1:
            ids = lists.column("id").flatten().unique()
            hot = lists.column("n").to_numpy() > share * len(ids)
            part[hot] += zlib.crc32(str(ids[0]).encode()) % over
        part %= parts
        order = np.argsort(part, kind="stable")
        lists, part = lists.take(pa.array(order)), part[order]
        some, starts = np.unique(part, return_index=True)
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, lists.schema) as to:
                to.write_batch(lists.slice(lo, hi - lo))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out, pa.binary())], names=["part", "posts"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the pieces of a part, a term's as one up to SENT postings."""
    read = list(dealt(batches))
    if not read:
        return
    table = pa.Table.from_batches(read).combine_chunks()
    del read
    term, field = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "field"))
    fields = len(field.dictionary)
    key = term.indices.to_numpy(zero_copy_only=False).astype(np.int64) * fields + field.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, n, cf = key[order], table.column("n").to_numpy()[order], table.column("cf").to_numpy()[order]
    before = np.cumsum(n) - n
    first = np.concatenate([[True], key[1:] != key[:-1]])
    turn = (before - before[first][np.cumsum(first) - 1]) // SENT  # of a term with many postings
    starts = np.flatnonzero(first | np.concatenate([[True], turn[1:] != turn[:-1]]))
    names, kinds = np.divmod(key[starts], fields)
    lists = [table.column(c).combine_chunks().take(pa.array(order)).flatten() for c in ("id", "tf", "len")]
    yield from _lists(
        lambda x: [term.dictionary.take(pa.array(names[x])), field.dictionary.take(pa.array(kinds[x]))], np.append(before[starts], before[-1] + n[-1]), np.add.reduceat(cf, starts),
        lambda x: [v.slice(x.start, x.stop - x.start) for v in lists], SENT,
    )


def deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, posts): the postings (id, slot, impact) of lists (id, tf, len, slot, idf, avg_len), a piece for each block of documents that has some."""
    for batch in batches:
        lists = batch.column("id")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        each = lambda c, n=n, batch=batch: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)
        ids, tf, length = lists.flatten(), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tf", "len"))
        impact = each("idf") * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / each("avg_len"))))
        part = _parts(ids, parts)
        order = np.argsort(part, kind="stable")
        table = pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.array(each("slot")[order]), pa.array(impact[order])], names=["id", "slot", "impact"])
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(ends))
        for p in some.tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table.slice(ends[p], ends[p + 1] - ends[p]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "posts"])


def _parts(ids: pa.Array, parts: int) -> np.ndarray:
    """The block of every id, by a hash of it."""
    if pa.types.is_integer(ids.type):
        x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    coded = ids.dictionary_encode(null_encoding="encode")
    return np.array([zlib.crc32(str(x).encode()) % parts for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy(zero_copy_only=False)]


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings in pieces that :func:`deal` made."""
    for batch in batches:
        for piece in batch.column("posts"):
            yield from pa.ipc.open_stream(piece.as_buffer())


class Asked:
    """Queries as numbers: query ``number[i]`` asks ``slot[at[starts[i]:starts[i + 1]]]``."""

    def __init__(self, got: pa.Table):
        lists = got.column("slots").combine_chunks()
        self.number = got.column("qno").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]).astype(np.int64)
        self.slot, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        self.at = at.astype(np.int32)


def best(batches: Iterator[pa.RecordBatch], asked: Asked, k: int) -> Iterator[pa.RecordBatch]:
    """(qno, id, score): the ``k`` best documents of every query among all postings (id, slot, impact) of a partition, ties by id."""
    read = [b for b in batches if b.num_rows]
    if not read or not len(asked.number):
        return
    table = pa.Table.from_batches(read)
    coded = table.column("id").combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    ids = coded.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[coded.indices.to_numpy(zero_copy_only=False)]
    slot = table.column("slot").to_numpy()
    at = np.minimum(np.searchsorted(asked.slot, slot), len(asked.slot) - 1)
    mine = np.flatnonzero(asked.slot[at] == slot)
    mine = mine[np.argsort(at[mine], kind="stable")]
    at, row, impact = at[mine], row[mine], table.column("impact").to_numpy()[mine]
    del table, coded, read, slot, mine
    ends = np.searchsorted(at, np.arange(len(asked.slot) + 1))
    out: list = []
    for lo, scores in _scores(row, impact, ends, len(ids), asked):
        q, r, s = _top(scores, k)
        out.append((asked.number[lo + q], r, s))
        if sum(len(x[0]) for x in out) >= OUT * k:
            yield _batch(out, ids)
            out = []
    if out:
        yield _batch(out, ids)


def _batch(out: list, ids: pa.Array) -> pa.RecordBatch:
    q, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(r)), pa.array(s)], names=["qno", "id", "score"])


def _scores(row: np.ndarray, impact: np.ndarray, ends: np.ndarray, n: int, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores of some queries by document); the width is ``n`` filled up to a multiple of GROUP."""
    wide = -(-n // GROUP) * GROUP
    held, many = np.diff(ends), len(asked.number)
    work = held * np.bincount(asked.at, minlength=len(held)).astype(float)
    dense = np.argsort(-work, kind="stable")[: max(0, DENSE_BYTES // (8 * wide))]
    dense = dense[work[dense] > DENSE_SHARE * n * many]
    matrix = np.zeros((len(dense), wide))
    for f, t in enumerate(dense.tolist()):
        matrix[f, row[ends[t] : ends[t + 1]]] = impact[ends[t] : ends[t + 1]]
    column = np.full(len(held), -1)
    column[dense] = np.arange(len(dense))
    single = (column < 0) & (held > 0)
    step = max(1, SCORE_BYTES // (8 * wide))
    for lo in range(0, many, step):
        hi = min(many, lo + step)
        terms = asked.at[asked.starts[lo] : asked.starts[hi]]
        query = np.repeat(np.arange(hi - lo), np.diff(asked.starts[lo : hi + 1]))
        weight = np.zeros((hi - lo, len(dense)))
        shared = column[terms] >= 0
        np.add.at(weight, (query[shared], column[terms[shared]]), 1.0)
        scores = weight @ matrix
        rest = single[terms]
        terms = terms[rest]
        cuts = np.searchsorted(query[rest], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            ts = terms[cuts[i] : cuts[i + 1]]
            if len(ts):
                spans = [slice(a, b) for a, b in zip(ends[ts].tolist(), ends[ts + 1].tolist(), strict=True)]
                np.add.at(scores[i], np.concatenate([row[x] for x in spans]), np.concatenate([impact[x] for x in spans]))
        yield lo, scores


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents of every query by (score to nine places, document); a document without a term of it has score 0 and is none.

    The k-th greatest of the maxima of groups is at most the k-th score, so that only groups that reach it are looked into.
    """
    many, wide = scores.shape
    cells = scores.reshape(many, GROUP, wide // GROUP)
    most = cells.max(axis=1)
    groups = most.shape[1]
    least = np.partition(most, groups - k, axis=1)[:, groups - k] - 2e-9 if groups > k else np.zeros(many)
    least = np.maximum(least, 0.0)
    q, g = np.nonzero((most >= least[:, None]) & (most > 0))
    found = cells[q, :, g]
    x, j = np.nonzero((found >= least[q][:, None]) & (found > 0))
    score, q, r = found[x, j], q[x], j * groups + g[x]
    order = np.lexsort((r, -np.round(score, 9), q))
    score, q, r = score[order], q[order], r[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    turn = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[turn < k], r[turn < k], score[turn < k]
