r"""Source divergence audit by sketch-prefiltered counting and sparse pair joins.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased.
A first pass over the texts fills a count-min sketch of document frequencies by
(lang, term); the sketches of all tasks are added up, cells stop at 255 and
never tell less than the truth.  The second pass discards, before anything is
shuffled, every term whose least cell is below ``min_docs``; the survivors are
counted exactly by (lang, source, term), strings and not hashes, and a lang's
vocabulary is its V terms in at least ``min_docs`` documents.

With count n of a term and N of all kept terms, a group gives each kept term
p = 1 + floor(10^9 (n + 5) / (N + 5 V)), b where n = 0.  The distance of two
sources s, t of a lang is the sum of abs(p_s - p_t) over all kept terms:

    V abs(b_s - b_t) + E_s(t) + E_t(s) + C(s, t), where
    E_s(t) sums abs(p_s - b_t) - abs(b_s - b_t) over the terms of s, and
    C(s, t) sums abs(p_s - p_t) - abs(p_s - b_t) - abs(b_s - p_t) + abs(b_s - b_t) over the terms of both.

E needs the histogram of p of one source only.  C is the sparse join: a term's
sources meet in tiles of 512, one row for two tiles, and each task adds the
pairs of its rows into one matrix for two tiles before any row leaves it, so a
term in every source costs no row for each pair.  All sums are exact integers.

Edge cases: null text, lang and source are read as ''; a text without terms
still makes its group occur; a lang without kept terms has pairs of value 0 and
no term rows; an empty table gives no rows; repeated rows and ids count as
often as they are there; ties of a rank go by the item's UTF-8 bytes.  Only the
three named columns are read, so others may have any name.  A text is held
whole by a worker, at about 50 bytes a byte.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import rolling as r

#: Bytes of a term: ASCII letters and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Rows of the sketch, and the odd multipliers that place a key in each.
ROW_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Cells of a sketch row: 16 for each document, within these bounds (64 MB in all at most).
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
#: Sketch bytes of one shuffled block, text bytes worked on at once, and words of one exact count.
BLOCK, SLICE, WORDS = 1 << 18, 1 << 19, 1 << 20
TILE = 512
SMOOTH, SCALE = 5, 1_000_000_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("lang", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("value", pa.int64())])


def _keys(s: r.Slice, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts, ends, document and (lang, term) key of every word of a slice."""
    starts, ends, bounds = r.words(s, LETTERS)
    data = r.LOWER[s.data]
    doc = np.repeat(np.arange(len(s.ids)), np.diff(bounds))
    return data, starts, ends, doc, r.mix(r.word_hashes(data, starts, ends) ^ langs[doc])


def _lang_keys(column: pa.Array) -> np.ndarray:
    """A 64-bit number for each row's lang."""
    codes = column.dictionary_encode()
    named = np.array([zlib.crc32(v.encode()) for v in codes.dictionary.to_pylist()], np.uint64)
    return r.mix(named * np.uint64(r.BASE2))[codes.indices.to_numpy()] if len(named) else np.zeros(0, np.uint64)


def _places(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((keys * ROW_KEYS[row]) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def _add(table: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    """Saturating addition of ``counts`` at ``at``, where places may repeat."""
    order = np.argsort(at)
    starts, _ = r.runs(at[order])
    if len(starts):
        where = at[order][starts]
        table[where] = np.minimum(table[where] + np.add.reduceat(counts[order], starts), 255).astype(np.uint8)


def sketch_cells(n_docs: int) -> int:
    """Cells of a row: a power of two that grows with the documents within the stated bounds."""
    return min(max(LEAST_CELLS, 1 << (16 * max(n_docs, 1) - 1).bit_length()), MOST_CELLS)


def sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """The merged count-min sketch of document frequencies by (lang, term): 4 rows of ``cells`` bytes."""

    def fill(batches):
        table = np.zeros((len(ROW_KEYS), cells), np.uint8)
        some = False
        for batch in batches:
            langs = _lang_keys(batch.column("lang"))
            for s in r.slices(batch, "at", "text", SLICE):
                *_, doc, key = _keys(s, langs[s.rows])
                distinct, code = np.unique(key, return_inverse=True)
                if not len(distinct):
                    continue
                some = True
                in_docs = np.bincount(np.unique(doc * len(distinct) + code) % len(distinct), minlength=len(distinct))
                for row in range(len(ROW_KEYS)):
                    _add(table[row], _places(distinct, row, cells), in_docs)
        flat = table.reshape(-1)
        for b in range(0, len(flat) if some else 0, BLOCK):
            if flat[b : b + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK]), pa.array([r.CODEC.compress(flat[b : b + BLOCK].tobytes(), asbytes=True)])], names=["block", "cells"])

    def merge(batches):
        """Blocks arrive sorted; one is held at a time."""
        now, total = None, None
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(r.CODEC.decompress(blob, min(BLOCK, len(ROW_KEYS) * cells), asbytes=True), np.uint8)
                if block != now:
                    if now is not None:
                        yield _block_row(now, total)
                    now, total = block, part
                else:
                    total = np.minimum(total.astype(np.uint16) + part, 255).astype(np.uint8)
        if now is not None:
            yield _block_row(now, total)

    blocks = -(-len(ROW_KEYS) * cells // BLOCK)
    merged = docs.mapInArrow(fill, "block long, cells binary").repartition(min(blocks, 64), "block").sortWithinPartitions("block").mapInArrow(merge, "block long, cells binary")
    out = np.zeros(len(ROW_KEYS) * cells, np.uint8)
    for row in merged.toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(r.CODEC.decompress(bytes(row["cells"]), min(BLOCK, len(out)), asbytes=True), np.uint8)
    return out.reshape(len(ROW_KEYS), cells)


def _block_row(block: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([r.CODEC.compress(cells.tobytes(), asbytes=True)])], names=["block", "cells"])


def possible_counts(docs: DataFrame, table: np.ndarray, min_docs: int) -> DataFrame:
    """(lang, source, term, docs, n): exact counts, in parts, of every term that the sketch does not rule out."""
    held = docs.sparkSession.sparkContext.broadcast(table)
    cells, words, slice_bytes = table.shape[1], WORDS, SLICE

    def count(batches):
        sketched, parts = held.value, Words()
        for batch in batches:
            langs = _lang_keys(batch.column("lang"))
            for s in r.slices(batch, "at", "text", slice_bytes):
                data, starts, ends, doc, key = _keys(s, langs[s.rows])
                distinct, code = np.unique(key, return_inverse=True)
                may = np.ones(len(distinct), bool)
                for row in range(len(ROW_KEYS)):
                    may &= sketched[row][_places(distinct, row, cells)] >= min_docs
                stays = may[code]
                if stays.any():
                    size = ends - starts
                    parts.add(data[LETTERS[data]][np.repeat(stays, size)], size[stays], doc[stays], batch.column("lang").slice(s.rows.start, len(s.ids)), batch.column("source").slice(s.rows.start, len(s.ids)))
                    if parts.n >= words:
                        yield parts.rows()
        if parts.n:
            yield parts.rows()

    return docs.mapInArrow(count, "lang string, source string, term string, docs long, n long")


class Words:
    """Words of some documents, kept as bytes until they are counted together."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n, self.docs = 0, 0
        self.data, self.sizes, self.doc, self.langs, self.sources = [], [], [], [], []

    def add(self, data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, langs: pa.Array, sources: pa.Array) -> None:
        self.data.append(data)
        self.sizes.append(sizes)
        self.doc.append(doc + self.docs)
        self.langs.append(langs)
        self.sources.append(sources)
        self.n += len(sizes)
        self.docs += len(langs)

    def rows(self) -> pa.RecordBatch:
        """(lang, source, term, docs, n) of the words held, which go."""
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.concatenate(self.sizes), out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.data))).dictionary_encode()
        term, doc = words.indices.to_numpy().astype(np.int64), np.concatenate(self.doc)
        langs, sources = (pa.concat_arrays(x).dictionary_encode() for x in (self.langs, self.sources))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        many = len(words.dictionary)
        each, n = np.unique(doc * many + term, return_counts=True)
        key = group[each // many] * many + each % many
        order = np.argsort(key, kind="stable")
        starts, docs = r.runs(key[order])
        found = key[order][starts]
        out = pa.RecordBatch.from_arrays([
            langs.dictionary.take(pa.array(found // many // len(sources.dictionary))), sources.dictionary.take(pa.array(found // many % len(sources.dictionary))),
            words.dictionary.take(pa.array(found % many)).cast(pa.string()), pa.array(docs.astype(np.int64)), pa.array(np.add.reduceat(n[order], starts).astype(np.int64)),
        ], schema=COUNTS)
        self.clear()
        return out


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 5) / (N + 5 V)), exact beyond 64 bits."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(19, 0)) DIV CAST({total} + {SMOOTH} * {kept} AS DECIMAL(19, 0))").cast("long")


def shared_terms(entries: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): C(lo, hi) in parts, from rows (lang, term, i, p, b) of a term's sources."""
    size = TILE
    tiles = entries.groupBy("lang", "term", F.expr("i DIV " + str(TILE)).alias("tile")).agg(F.sort_array(F.collect_list(F.struct((F.col("i") % TILE).cast("int").alias("i"), "p", "b"))).alias("xs"))
    if (entries.agg(F.max("i")).first()[0] or 0) < TILE:
        met = tiles.select("lang", F.col("tile").alias("ta"), F.col("tile").alias("tb"), F.col("xs").alias("xa"), F.lit(None).cast(tiles.schema["xs"].dataType).alias("xb"))
    else:
        tiles = cluster.cut(tiles, "op13-tiles")
        a, b = (tiles.select("lang", "term", F.col("tile").alias(f"t{k}"), F.col("xs").alias(f"x{k}")) for k in "ab")
        met = a.join(b, ["lang", "term"]).filter("ta <= tb").select("lang", "ta", "tb", "xa", F.when(F.col("ta") < F.col("tb"), F.col("xb")).alias("xb"))

    def parts(xs: pa.Array):
        x = xs.flatten()
        return tuple(x.field(k).to_numpy().astype(np.int64) for k in range(3)), np.append(0, np.cumsum(xs.value_lengths().fill_null(0).to_numpy()))

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            (ia, pa_, ba), at = parts(batch.column("xa"))
            (ib, pb, bb), to = parts(batch.column("xb"))
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "ta", "tb")), strict=True)):
                if key not in held:
                    if len(held) >= 32:
                        yield from _matrix_rows(held, size)
                    held[key] = np.zeros((size, size), np.int64)
                a = slice(at[k], at[k + 1])
                i, p, b = ia[a], pa_[a, None], ba[a, None]
                j, q, c = (ib[to[k] : to[k + 1]], pb[to[k] : to[k + 1]], bb[to[k] : to[k + 1]]) if key[1] != key[2] else (i, p[:, 0], b[:, 0])
                held[key][np.ix_(i, j)] += np.abs(p - q) - np.abs(p - c) - np.abs(b - q) + np.abs(b - c)
        yield from _matrix_rows(held, size)

    return met.mapInArrow(add, "lang string, lo long, hi long, value long")


def _matrix_rows(held: dict, size: int):
    """The pairs lo < hi of every matrix, which go."""
    for (lang, ta, tb), m in held.items():
        if ta == tb:
            m = np.triu(m, 1)
        lo, hi = np.nonzero(m)
        if len(lo):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(lo), pa.string()), pa.array(lo + ta * size), pa.array(hi + tb * size), pa.array(m[lo, hi])], schema=PAIRS)
    held.clear()


def lone_terms(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): V abs(b_s - b_t) once and E_s(t) for each s, t, in parts of the histograms."""
    hist = cluster.cut(entries.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("m")), "op13-hist")
    most = hist.groupBy("lang", "i").count().agg(F.max("count")).first()[0] or 0
    pieces = hist.groupBy("lang", "i", F.pmod(F.xxhash64("p"), F.lit(most // 4096 + 1)).alias("piece")).agg(F.collect_list(F.struct("p", "m")).alias("ps"))
    first = groups.select("lang", "i", "b", "kept", F.lit(True).alias("first"), F.lit(None).cast("array<struct<p:long,m:long>>").alias("ps"))
    rest = pieces.join(cluster.sized(groups.select("lang", "i", "b", "kept"), 64), ["lang", "i"]).select("lang", "i", "b", "kept", F.lit(False).alias("first"), "ps")
    tiles = groups.groupBy("lang", F.expr("i DIV " + str(TILE)).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("i", "b"))).alias("others"))
    met = first.unionByName(rest).join(cluster.sized(tiles, 16 * TILE), "lang")

    def add(batches):
        for batch in batches:
            for row in batch.to_pylist():
                j, c = (np.array([x[k] for x in row["others"]], np.int64) for k in "ib")
                s, b = row["i"], row["b"]
                if row["first"]:
                    on = j > s
                    value = row["kept"] * np.abs(b - c)
                else:
                    on = j != s
                    p, m = (np.array([x[k] for x in row["ps"]], np.int64) for k in "pm")
                    value = np.abs(p[:, None] - c).T @ m - np.abs(b - c) * m.sum()
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * int(on.sum()), pa.string()), pa.array(np.minimum(j, s)[on]), pa.array(np.maximum(j, s)[on]), pa.array(value[on])], schema=PAIRS)

    return met.mapInArrow(add, "lang string, lo long, hi long, value long")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms most in excess of the lang."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must lie in 1 to 255, the highest count of a cell")
    read = docs.select(F.lit(0).cast("long").alias("at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    table = sketch(read.select("at", "text", "lang"), cells or sketch_cells(read.count()))
    counts = cluster.cut(possible_counts(read, table, min_docs).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "op13-counts")
    terms = cluster.cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("n_lang")).filter(F.col("in_docs") >= min_docs).drop("in_docs"), "op13-terms")
    kept = cluster.cut(counts.drop("docs").join(terms, ["lang", "term"]), "op13-kept")
    langs = terms.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("kept"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    there = cluster.cut(read.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0), "op13-there")
    groups = cluster.cut(
        cluster.numbered(there, "lang", "source", "i").withColumn("zero", F.lit(0)).withColumn("b", F.when(F.col("kept") > 0, share("zero", "total", "greatest(kept, 1)")).otherwise(0)).drop("zero"), "op13-groups")
    n_groups, total = groups.agg(F.count(F.lit(1)), F.sum("rows")).first()
    sides = groups.select("lang", "source", "i", "b", "total", "total_lang", F.col("kept").alias("v"), "rows")
    joined = kept.join(F.broadcast(sides.drop("rows")), ["lang", "source"]) if n_groups * 128 <= cluster.BROADCAST_BYTES else cluster.join_heavy(kept, sides, ["lang", "source"], "rows", total or 1)
    entries = cluster.cut(joined.select("lang", "source", "term", "i", "b", share("n", "total", "v").alias("p"), share("n_lang", "total_lang", "v").alias("q")), "op13-entries")
    values = shared_terms(entries).unionByName(lone_terms(entries, groups)).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    both = values.select("lang", "value", F.explode(F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j")))).alias("x")).select("lang", "value", "x.i", "x.j")
    names = cluster.sized(groups.select("lang", "i", "source"), 64, n_groups)
    pairs = both.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    excess = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(excess.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
