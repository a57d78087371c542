"""Language identification by word-first backoff.

Counts of whole words per language come from all learning documents; a known
word scores its log frequency in each language.  An unseen word falls back to
its longest character n-grams that are known: 4, then 3, 2 and 1 characters,
with word edges marked.  The counts grow with the corpus and stay in Spark, and
all of them score.  A table below ``cluster.BROADCAST_BYTES`` is broadcast;
with a larger one, chunks of documents ask its hash partitions for the keys
they hold, and each chunk is scored by the same code over what it is answered.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
learning rows without a language or text are left out; ties go to the label
that sorts first; repeated rows count each and come out each, null ids too;
without learning rows everything is ``und``; an empty table gives no rows.
Only doc_id, text and (to learn) lang are read, so other columns may have any
name.  A text is held whole: one of n bytes takes about 55 n bytes of a worker
(measured at 8 MB).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import repeats as rep
from lexloom.llm import rolling as r
from lexloom.llm.decontaminate import Lookup

GRAMS, SMOOTH = (4, 3, 2, 1), 0.5
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, np.uint8)  # 0 unknown, 1 no, 2 yes


def is_letter(points: np.ndarray) -> np.ndarray:
    kind = _LETTER[points]
    if (kind == 0).any():
        for c in np.unique(points[kind == 0]).tolist():
            _LETTER[c] = 2 if chr(c).isalpha() else 1
        kind = _LETTER[points]
    return kind == 2


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code point values (0 where no letter), word starts and ends, and the document of each word."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    m = is_letter(points)
    values = np.where(m, r.mix(points.astype(np.uint64) + np.uint64(77)), np.uint64(0x5851F42D4C957F2D))
    starts, ends = np.flatnonzero(m[1:] & ~m[:-1]) + 1, np.flatnonzero(m[:-1] & ~m[1:]) + 1
    heads = np.cumsum([1] + [len(t) + 1 for t in low])
    return values, starts, ends, np.searchsorted(heads, starts, "right") - 1


def word_keys(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return r.mix(r.span_sums(values, r.POWERS, starts, ends) ^ (ends - starts).astype(np.uint64))


def grams(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``n``-grams of words (edges included for n > 1) and the number of their word."""
    edge = int(n > 1)
    count = np.maximum(ends - starts + 2 * edge - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(starts - edge, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    up, down = r.POWERS2.upto(n + 1)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h += values[at + k] * up[k]
    return r.mix(h ^ np.uint64(n)), word


def texts_of(s: r.Slice) -> list[str]:
    return [s.text(k).decode("utf-8", "replace") for k in range(len(s.ids))]


def count_words(docs: DataFrame, labels: list[str], parts: int, least: int = 2) -> DataFrame:
    """(part, n, key, first, label, count) over every document of (text, lang): n is 0 for words, else the n-gram length.

    Keys met fewer than ``least`` times are left out; ``first`` marks one row of each key.
    """
    number = {x: k for k, x in enumerate(labels)}

    def send(batches):
        held, size = [], 0

        def flush():
            sums: dict[int, tuple] = {}
            key, lab, tot, reps = (np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True))
            for n in (0, *GRAMS):
                at = reps == n
                order = np.lexsort((lab[at], key[at]))
                k, l, c = key[at][order], lab[at][order], tot[at][order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
                if len(k):
                    sums[n] = k[new], l[new], np.add.reduceat(c, np.flatnonzero(new))
            for n, (k, l, c) in sums.items():
                p = (k % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((k, p))
                k, l, c, p = k[order], l[order], c[order], p[order]
                a, sizes = r.runs(p)
                blobs = [r.pack(k[i : i + j], l[i : i + j], c[i : i + j]) for i, j in zip(a, sizes, strict=True)]
                yield pa.record_batch([pa.array(p[a] * 8 + n, pa.int32()), pa.array([False] * len(a)), pa.array(blobs, pa.binary())], schema=rep.ENTRIES)

        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                lab = np.array([number[x] for x in batch.column("lang").slice(s.rows.start, len(s.ids)).to_pylist()])
                values, starts, ends, doc = letter_words(texts_of(s))
                if not len(starts):
                    continue
                key = word_keys(values, starts, ends)
                order = np.lexsort((lab[doc], key))
                k, l = key[order], lab[doc][order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(k)))
                held.append((k[at], l[at], count, np.zeros(len(at), np.int64)))
                size += len(at)
                first = order[at]
                for n in GRAMS:
                    g, word = grams(values, starts[first], ends[first], n)
                    wl, wc = l[at][word], count[word]
                    o = np.lexsort((wl, g))
                    g, wl, wc = g[o], wl[o], wc[o]
                    fresh = np.ones(len(g), bool)
                    fresh[1:] = (g[1:] != g[:-1]) | (wl[1:] != wl[:-1])
                    i = np.flatnonzero(fresh)
                    if len(i):
                        held.append((g[i], wl[i], np.add.reduceat(wc, i), np.full(len(i), n)))
                        size += len(i)
                if size > 2 * rep.CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def total(table: pa.Table) -> pa.Table:
        got = [r.unpack(x.as_buffer()) for x in table.column("blob")]
        k, l, c = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((l, k))
        k, l, c = k[order], l[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
        at = np.flatnonzero(new)
        sums = np.add.reduceat(c, at)
        keys, n = r.runs(k[at])
        whole = np.repeat(np.add.reduceat(sums, keys), n)
        some = whole >= least
        first = np.zeros(len(at), bool)
        first[keys] = True
        part = table.column("part")[0].as_py()
        return pa.table([pa.array(np.full(int(some.sum()), x), pa.int32()) for x in (part, part % 8)] + [pa.array(k[at][some].view(np.int64)), pa.array(first[some]), pa.array(l[at][some], pa.int32()), pa.array(sums[some])], names=["part", "n", "key", "first", "label", "count"])

    return docs.mapInArrow(send, rep.ENTRIES_SQL).groupBy("part").applyInArrow(total, "part int, n int, key long, first boolean, label int, count long")


class Model:
    """Log frequencies by key of words (0) and n-grams (1 to 4); ``totals`` and ``sizes`` are those of the whole table."""

    def __init__(self, labels: list[str], rows: dict[int, np.ndarray], totals: np.ndarray, sizes: np.ndarray):
        self.labels, self.tables = labels, {}
        for n, x in rows.items():
            keys = np.unique(x[:, 0].view(np.uint64))
            counts = np.full((len(keys), len(labels)), SMOOTH)
            counts[np.searchsorted(keys, x[:, 0].view(np.uint64)), x[:, 1]] += x[:, 2]
            self.tables[n] = Lookup(keys), np.log(counts / (totals[n] + SMOOTH * max(1, int(sizes[n])))).astype(np.float32)

    def word_scores(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log scores by word and label."""
        per = np.zeros((len(starts), len(self.labels)), np.float32)
        left = np.arange(len(starts))
        if 0 in self.tables and len(left):
            lookup, logs = self.tables[0]
            at, k = lookup.find(word_keys(values, starts, ends))
            per[at] = logs[k]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left = left[rest]
        for n in GRAMS:
            if n not in self.tables or not len(left):
                continue
            lookup, logs = self.tables[n]
            g, word = grams(values, starts[left], ends[left], n)
            at, k = lookup.find(g)
            hits = np.bincount(word[at], minlength=len(left))
            some = hits > 0
            for j in range(len(self.labels)):
                per[left[some], j] = np.bincount(word[at], weights=logs[k, j], minlength=len(left))[some] / hits[some]
            left = left[~some]
        return per

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log scores by document and label; whether a document has a letter."""
        values, starts, ends, doc = letter_words(texts)
        per = self.word_scores(values, starts, ends)
        out = np.zeros((len(texts), len(self.labels)))
        for j in range(len(self.labels)):
            out[:, j] = np.bincount(doc, weights=per[:, j], minlength=len(texts))
        return out, np.bincount(doc, minlength=len(texts)) > 0

    def choose(self, logs: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Label and posterior of each document."""
        best = logs.argmax(1)
        p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        return [self.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, p, 0.0)


class Counts:
    """The count table of learned labels: cut in Spark as ``found``, and as ``model`` where it is small enough to broadcast."""

    def __init__(self, labels: list[str], found: DataFrame | None, totals: np.ndarray, sizes: np.ndarray, parts: int):
        self.labels, self.found, self.totals, self.sizes, self.parts = labels, found, totals, sizes, parts
        self.model = None


def table_rows(table: pa.Table) -> dict[int, np.ndarray]:
    """(key, label, count) rows by n."""
    n = table.column("n").to_numpy()
    x = np.stack([np.asarray(table.column(c).to_numpy(), np.int64) for c in ("key", "label", "count")], 1)
    return {int(k): x[n == k] for k in np.unique(n)}


def learn(docs: DataFrame) -> Counts:
    """Learn from every row of (doc_id, text, lang) with a text and a language."""
    docs = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    labels = sorted(x[0] for x in docs.select("lang").distinct().collect())
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    totals, sizes = np.zeros((5, len(labels))), np.zeros(5, np.int64)
    parts = cluster.prime(max(13, total // 24 // rep.PER_PARTITION))
    if not labels:
        return Counts(labels, None, totals, sizes, parts)
    found = cluster.cut(count_words(docs, labels, parts, least=1), "op5-counts")
    rows = 0
    for x in found.groupBy("n", "label").agg(F.sum("count").alias("c"), F.count_if("first").alias("k"), F.count(F.lit(1)).alias("rows")).collect():
        totals[x.n, x.label] = x.c
        sizes[x.n] += x.k
        rows += x.rows
    counts = Counts(labels, found, totals, sizes, parts)
    if max(rows * 24, int(sizes.sum()) * (8 + 4 * len(labels))) <= cluster.BROADCAST_BYTES:
        counts.model = Model(labels, table_rows(found.select("n", "key", "label", "count").toArrow()), totals, sizes)
        cluster.drop(found)
    return counts


OUT_SQL = "doc_id long, lang_pred string, score double"


#: Bytes of text whose documents ask the count table together, and code points of words hashed at once.
CHUNK_BYTES, BLOCK = 32 << 20, 1 << 18
CHUNKS_SQL = "chunk long, ids array<long>, n_pairs binary, pairs binary, words binary"


def word_blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code point values, starts and ends of words that :func:`letter_words` found, some at a time."""
    ends = np.cumsum([len(w) + 1 for w in words])
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        points = np.frombuffer(("\n" + "\n".join(words[at:to]) + "\n").encode("utf-32-le"), np.uint32)
        m = points != 10
        values = np.where(m, r.mix(points.astype(np.uint64) + np.uint64(77)), np.uint64(0x5851F42D4C957F2D))
        yield values, np.flatnonzero(m[1:] & ~m[:-1]) + 1, np.flatnonzero(m[:-1] & ~m[1:]) + 1
        at = to


def chunked(docs: DataFrame) -> DataFrame:
    """Documents by chunk: their ids, how many (word, count) pairs each has, the pairs, and the chunk's distinct words."""

    def go(batches):
        held, size = [], 0

        def flush():
            keys, turn = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            words = [""] * len(keys)
            for w, k in zip((w for h in held for w in h[2]), turn.tolist(), strict=True):
                words[k] = w
            base = np.cumsum([0] + [len(h[1]) for h in held])
            word = np.concatenate([turn[b + h[4]] for b, h in zip(base[:-1], held, strict=True)])
            ids = pa.concat_arrays([h[0] for h in held])
            row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            n_pairs, times = np.concatenate([h[3] for h in held]), np.concatenate([h[5] for h in held])
            blobs = [pa.array([x], pa.binary()) for x in (n_pairs.astype(np.int32).tobytes(), r.pack(None, word, times), "\n".join(words).encode())]
            chunk = int(np.frombuffer(uuid.uuid4().bytes[:8], np.int64)[0])
            return pa.record_batch([pa.array([chunk], pa.int64()), row, *blobs], names=["chunk", "ids", "n_pairs", "pairs", "words"])

        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                texts = texts_of(s)
                values, starts, ends, doc = letter_words(texts)
                keys, first, turn = np.unique(word_keys(values, starts, ends), return_index=True, return_inverse=True)
                joined = "\n" + "\n".join(t.lower() for t in texts) + "\n"
                words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                pair, times = np.unique(doc * max(1, len(keys)) + turn, return_counts=True)
                ids = batch.column("doc_id").slice(s.rows.start, len(s.ids)).cast(pa.int64())
                held.append((ids, keys, words, np.bincount(pair // max(1, len(keys)), minlength=len(texts)), pair % max(1, len(keys)), times))
                size += len(s.data)
                if size >= CHUNK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(go, CHUNKS_SQL)


def words_of(blob: bytes) -> list[str]:
    return blob.decode().split("\n") if blob else []


def predict_apart(docs: DataFrame, counts: Counts) -> DataFrame:
    """:func:`predict` against a count table that stays in hash partitions."""
    labels, totals, sizes, parts = counts.labels, counts.totals, counts.sizes, counts.parts
    chunks = cluster.cut(chunked(docs), "op5-chunks")

    def ask(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
                keys: dict[int, list] = {n: [] for n in (0, *GRAMS)}
                for values, starts, ends in word_blocks(words_of(blob)):
                    keys[0].append(word_keys(values, starts, ends))
                    for n in GRAMS:
                        keys[n].append(np.unique(grams(values, starts, ends, n)[0]))
                for n, got in keys.items():
                    k = np.unique(np.concatenate([np.zeros(0, np.uint64), *got]))
                    p = (k % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(p, kind="stable")
                    k, p = k[order], p[order]
                    a, some = r.runs(p)
                    blobs = [k[i : i + j].tobytes() for i, j in zip(a, some, strict=True)]
                    yield pa.record_batch([pa.array(p[a] * 8 + n, pa.int32()), pa.array([chunk] * len(a), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "chunk", "blob"])

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and asked.num_rows:
            key, lab, c = (table.column(x).to_numpy() for x in ("key", "label", "count"))
            key = key.astype(np.int64).view(np.uint64)
            order = np.lexsort((lab, key))
            key, lab, c = key[order], lab[order].astype(np.int64), c[order]
            starts, length = r.runs(key)
            lookup = Lookup(key)
            n = table.column("n")[0].as_py()
            for chunk, blob in zip(asked.column("chunk").to_pylist(), asked.column("blob").to_pylist(), strict=True):
                k = lookup.find(np.frombuffer(blob, np.uint64))[1]
                m = length[k]
                at = np.repeat(starts[k] - np.cumsum(m) + m, m) + np.arange(m.sum())
                if len(at):
                    out.append((chunk, n, r.pack(key[at], lab[at], c[at])))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "n", "blob"])

    def score(held: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for n, blob in zip(answers.column("n").to_pylist(), answers.column("blob"), strict=True):
            k, lab, c = r.unpack(blob.as_buffer())
            rows.setdefault(n, []).append(np.stack([k.view(np.int64), lab, c], 1))
        m = Model(labels, {n: np.concatenate(x) for n, x in rows.items()}, totals, sizes)
        del rows
        words = words_of(held.column("words")[0].as_py())
        per = np.concatenate([np.zeros((0, len(labels)), np.float32), *(m.word_scores(*x) for x in word_blocks(words))])
        _, word, times = r.unpack(held.column("pairs")[0].as_buffer())
        n_pairs = np.frombuffer(held.column("n_pairs")[0].as_py(), np.int32)
        doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
        logs = np.stack([np.bincount(doc, weights=per[word, j] * times, minlength=len(n_pairs)) for j in range(len(labels))], 1)
        best, p = m.choose(logs, n_pairs > 0)
        return pa.table([held.column("ids").combine_chunks().flatten(), pa.array(best, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    asked = chunks.select("chunk", "words").mapInArrow(ask, "part int, chunk long, blob binary")
    answers = counts.found.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "chunk long, n int, blob binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, OUT_SQL)


def predict(docs: DataFrame, counts: Counts) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest label and its posterior under equal priors."""
    if counts.labels and counts.model is None:
        return predict_apart(docs, counts)
    held = docs.sparkSession.sparkContext.broadcast(counts.model)

    def go(batches):
        m = held.value
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text", r.SLICE_BYTES):
                n = len(s.ids)
                labels, scores = m.choose(*m.scores(texts_of(s))) if m else ([UNKNOWN] * n, np.zeros(n))
                yield pa.record_batch([batch.column("doc_id").slice(s.rows.start, n), pa.array(labels, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(go, OUT_SQL)
