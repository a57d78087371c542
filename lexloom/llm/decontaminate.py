"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (a shorter item
is one window).  Each window is a set of word shingles; shingles are ordered
by rarity over the whole corpus, and since a window must be contained whole,
its necessary prefix is its one rarest shingle.  Documents meet windows on
that shingle; the shingle's place in the window gives the only possible start
(positional bound), which must leave room for the whole window in the document
(length bound), and the words there are compared exactly, byte by byte.

The benchmark's windows are broadcast in blocks of at most ``block_bytes`` of
item text; a larger benchmark takes more passes over the documents, never more
memory.  A pass over a further block returns only the documents it hits, by id
and digest of the text; rows that share both have the same result.

Edge cases: null or empty texts have no words and no windows; items without
words match nothing; a null item id can hit but is not listed; repeated items
count once; there is one row for every row of ``docs``, whatever the number of
blocks, for repeated and null ids too; an empty benchmark hits nothing; an
empty table gives no rows.  Only the two named columns of each side are read,
so other columns may have any name.  A text is held whole: one of n bytes takes
about 50 n bytes of a worker (measured at 8 MB); an item is held whole on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import rolling as r

#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 4
#: Item text of one block: its windows take about 60 bytes a byte on the driver and in each worker.
BLOCK_BYTES = 4 << 20

OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
OUT_SQL = "doc_id long, n_words long, n_hit long, items array<string>, hits array<struct<start:long,end:long>>"


class Lookup:
    """A hash set or map with a bit table in front, so that most probes cost one byte."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` whose value is a key, and the key's number."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def shingle_hashes(w: np.ndarray, s: int) -> np.ndarray:
    return r.mix(r.window_sums(w, s, r.POWERS) ^ np.uint64(s))


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` one after another, and the ``i`` of each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of


@dataclass
class Block:
    """The distinct windows of some items over their joined lower-case bytes, and the prefix index once counts are known."""

    data: np.ndarray  # lower-case bytes of all items
    starts: np.ndarray  # word bounds in data
    ends: np.ndarray
    first: np.ndarray  # first word and length of each distinct window
    length: np.ndarray
    owner_at: np.ndarray  # owners of window i: owners[owner_at[i] : owner_at[i + 1]], as places in items
    owners: np.ndarray
    items: list
    shingles: dict  # by size: the hash that starts at each word
    keys: np.ndarray | None = None  # rarest shingles, sorted; windows of key i: key_at[i] .. key_at[i + 1]
    key_at: np.ndarray | None = None
    window: np.ndarray | None = None
    offset: np.ndarray | None = None

    @property
    def sizes(self) -> list[int]:
        return sorted(self.shingles)


def block_of(items: pa.Table, window: int) -> Block:
    """Windows of (item, text) rows; equal ones are one, with all their items."""
    ids = items.column("item").to_pylist()
    one = pa.table([pa.array(np.arange(len(ids))), items.column("text").combine_chunks()], names=["i", "t"])
    s = next(r.slices(one, "i", "t", limit=1 << 62), r.Slice(np.zeros(0), np.zeros(0, np.uint8), np.zeros(1, np.int64), slice(0, 0), np.zeros(0, bool)))
    starts, ends, bounds = r.words(s, r.ALNUM)
    data = r.LOWER[s.data]
    w = r.word_hashes(data, starts, ends)
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    first, item = spread(bounds[:-1], count)
    length = np.minimum(n, window)[item]
    h = r.mix(r.span_sums(w, r.POWERS, first, first + length) ^ length.astype(np.uint64))
    h2 = r.mix(r.span_sums(r.mix(w), r.POWERS2, first, first + length))
    order = np.lexsort((item, h2, h))
    h, h2, item, first, length = h[order], h2[order], item[order], first[order], length[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    shingles = {int(k): shingle_hashes(w, int(k)) for k in np.unique(np.minimum(length, SHINGLE))}
    return Block(data, starts, ends, first[new], length[new], np.append(np.flatnonzero(new), len(h)), item, ids, shingles)


def window_shingles(b: Block):
    """(hash, window, offset) of every shingle of every distinct window."""
    for size, hashes in b.shingles.items():
        mine = np.flatnonzero(np.minimum(b.length, SHINGLE) == size)
        at, of = spread(b.first[mine], b.length[mine] - size + 1)
        yield hashes[at], mine[of], at - b.first[mine][of]


def corpus_counts(docs: DataFrame, keys: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The benchmark's shingles that occur in documents, sorted, and how often they do in all."""
    held = docs.sparkSession.sparkContext.broadcast(np.unique(keys))

    def go(batches):
        table = Lookup(held.value)
        total = np.zeros(len(table.keys), np.int64)
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                for h, at in _document_shingles(_document_words(s), sizes):
                    total += np.bincount(table.find(h[at])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(table.keys[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    found = docs.mapInArrow(go, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    shingle = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], found.column("n").to_numpy()[order]


def _document_words(s: r.Slice):
    starts, ends, bounds = r.words(s, r.ALNUM)
    return starts, ends, bounds, r.word_hashes(r.LOWER[s.data], starts, ends)


def _document_shingles(words, sizes: list[int]):
    _, _, bounds, w = words
    for size in sizes:
        if len(w) >= size:
            yield shingle_hashes(w, size), r.valid_windows(bounds, size)[0]


def with_prefixes(docs: DataFrame, b: Block) -> Block:
    """The block with its windows under their rarest shingle; windows with a shingle that no document has are gone."""
    none = np.zeros(0, np.int64)
    h, win, off = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), none, none), *window_shingles(b), strict=True))
    known, n = corpus_counts(docs, h, b.sizes) if len(h) else (h, win)
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    count = np.where(known[at] == h, n[at], 0) if len(known) else np.zeros(len(h), np.int64)
    order = np.lexsort((off, h, count, win))
    least = order[r.runs(win[order])[0]]
    least = least[count[least] > 0]
    least = least[np.argsort(h[least], kind="stable")]
    starts, _ = r.runs(h[least])
    b.keys, b.key_at, b.window, b.offset = h[least][starts], np.append(starts, len(least)), win[least], off[least]
    b.shingles = {k: v[:0] for k, v in b.shingles.items()}  # only their sizes are needed from here on
    return b


def matches(s: r.Slice, words, b: Block, table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(word, window) of every occurrence of a window in the documents of a slice."""
    starts, ends, bounds, _ = words
    low = None
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for h, at in _document_shingles(words, b.sizes):
        pos, key = table.find(h[at])
        if not len(pos):
            continue
        place, of = spread(b.key_at[key], b.key_at[key + 1] - b.key_at[key])
        where, win = at[pos][of], b.window[place]
        doc = np.searchsorted(bounds, where, "right") - 1
        a = where - b.offset[place]
        ok = (a >= bounds[doc]) & (a + b.length[win] <= bounds[doc + 1])
        a, win = a[ok], win[ok]
        if not len(a):
            continue
        low = r.LOWER[s.data] if low is None else low
        for lo in range(0, len(a), 20_000):  # word by word, then byte by byte, some candidates at a time
            x, y = a[lo : lo + 20_000], win[lo : lo + 20_000]
            mine, of = spread(x, b.length[y])
            its = b.first[y][of] + mine - x[of]
            size = ends[mine] - starts[mine]
            bad = np.zeros(len(x), bool)
            bad[of[size != b.ends[its] - b.starts[its]]] = True
            same = ~bad[of]
            byte, word = spread(starts[mine[same]], size[same])
            theirs = b.starts[its[same]][word] + byte - starts[mine[same]][word]
            bad[of[same][word[low[byte] != b.data[theirs]]]] = True
            out.append((x[~bad], y[~bad]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _one_block(docs: DataFrame, b: Block, hits_only: bool) -> DataFrame:
    """Hits of one block's windows; with ``hits_only`` the hit rows alone, each with the digest of its text."""
    held = docs.sparkSession.sparkContext.broadcast(b)
    schema = OUT.append(pa.field("digest", pa.string()))

    def go(batches):
        b = held.value
        table = Lookup(b.keys)
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                words = _document_words(s)
                bounds = words[2]
                a, win = matches(s, words, b, table)
                doc = np.searchsorted(bounds, a, "right") - 1
                n = len(s.ids)
                n_words, hit = np.diff(bounds), np.zeros(n, np.int64)
                items: list[list] = [[] for _ in range(n)]
                spans: list[list] = [[] for _ in range(n)]
                if len(a):
                    step = np.zeros(int(bounds[-1]) + 1, np.int32)
                    np.add.at(step, a, 1)
                    np.add.at(step, a + b.length[win], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.zeros(len(gone) + 1, bool)
                    edge[bounds] = True  # a run ends with its document
                    first, last = gone.copy(), gone.copy()
                    first[1:] &= ~gone[:-1] | edge[1:-1]
                    last[:-1] &= ~gone[1:] | edge[1:-1]
                    for x, y in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
                        d = int(np.searchsorted(bounds, x, "right")) - 1
                        spans[d].append({"start": x - int(bounds[d]), "end": y - int(bounds[d])})
                        hit[d] += y - x
                    for d, w in np.unique(np.stack([doc, win], 1), axis=0).tolist():
                        items[d] += b.owners[b.owner_at[w] : b.owner_at[w + 1]].tolist()
                named = [sorted({b.items[i] for i in x} - {None}) for x in items]
                part = batch.slice(s.rows.start, n)
                out = pa.record_batch([
                    part.column("doc_id"), pa.array(n_words), pa.array(hit), pa.array(named, OUT.types[3]), pa.array(spans, OUT.types[4]),
                    part.column("digest") if "digest" in batch.schema.names else pa.nulls(n, pa.string()),
                ], schema=schema)
                yield out.filter(pa.array(hit > 0)) if hits_only else out

    return docs.mapInArrow(go, OUT_SQL + ", digest string")


def _merged(spans: Column) -> Column:
    """Sorted (start, end) spans with touching and overlapping ones as one."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.array_append(done, s))

    return F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, hits): words inside item windows, the items that occur, and the hit runs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    if blocks == 1:
        return _one_block(docs, with_prefixes(docs, block_of(bench.toArrow(), window)), False).drop("digest")
    docs = docs.withColumn("digest", F.md5("text"))
    dealt = cluster.cut(bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "op2-items")
    found = []
    for k in range(blocks):
        b = with_prefixes(docs, block_of(dealt.filter(F.col("block") == k).select("item", "text").toArrow(), window))
        found.append(cluster.cut(_one_block(docs, b, k > 0), "op2-hits"))
    more = found[1]
    for one in found[2:]:
        more = more.union(one)
    # Rows of one id and text have the same hits, so the set of what they have is what each has.
    more = more.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.flatten(F.collect_set("items")).alias("_items"), F.flatten(F.collect_set("hits")).alias("_hits"))
    both = found[0].join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    hits = F.when(F.col("_id").isNull() & F.col("_digest").isNull(), F.col("hits")).otherwise(_merged(F.array_sort(F.concat("hits", "_hits"))))
    both = both.select("doc_id", "n_words", items.alias("items"), hits.alias("hits"))
    return both.select("doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"), "items", "hits")


def contaminated() -> Column:
    """At least one word in twenty lies inside an item's window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
