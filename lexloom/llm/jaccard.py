"""N-gram Jaccard join by PartEnum signatures.

Sets are the distinct word shingles of a text.  Sizes fall into bands with a
ratio of 1/threshold, so that similar sets lie in one band or in neighbours; a
set signs for its own band and the next.  In a band, similar sets differ in
at most k elements.  The feature domain is partitioned into n1 parts, of which
one has at most k2 of the differences; that part is partitioned again into n2,
and every subset of n2 - k2 of these is enumerated: similar sets share the
signature of a subset that no difference touches.

An empty projection says nothing and is not sent, unless a set has more parts
with an empty subset than the spare parts of its band cover; as one of two
similar sets always has a non-empty common signature otherwise, none is lost.

Candidates that share a signature are verified on their exact sets: first
against the smallest id of their group, then, where a group still spans several
components, all pairs across components whose sketches (a lower bound of the
difference) allow a link; a large group is compared block by block, in as many
tasks as it has pairs of blocks.  Links are closed by large-star and small-star steps
on distributed edges.

Edge cases: null and empty texts have no shingles, link with nothing and are
their own component; shorter texts are one shingle; equal sets are one class
whatever their texts; a null id is returned with a null component; rows that
share an id are one document, linked by any of its texts; every row comes out,
repeated ones too; an empty table gives no rows.  Only the two named columns
are read, so others may have any name.  A text is held whole: one of n bytes
takes about 50 n bytes of a worker (measured at 8 MB).  Links inside a component that is already
closed are not listed: the result is components, not pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import repeats as rep
from lexloom.llm import rolling as r

#: Cells of the two sketches of a set: counts by cell, and parities of counts by finer cell.
SKETCH, PARITY = 256, 4096


def shingle_sets(s: r.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, sorted by document and hash, and the document of each."""
    starts, ends, bounds = r.words(s, r.NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = r.word_hashes(r.LOWER[s.data], starts, ends)
    at, doc, _ = r.valid_windows(bounds, k)
    h = r.mix(r.window_sums(w, k, r.POWERS) ^ np.uint64(k))[at]
    count = np.diff(bounds)
    if (short := np.flatnonzero((count > 0) & (count < k))).size:
        whole = r.mix(r.span_sums(w, r.POWERS, bounds[short], bounds[short + 1]) ^ count[short].astype(np.uint64))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


class Bands:
    """Sizes, difference bounds and partitions of the bands up to ``top``."""

    def __init__(self, percent: int, top: int):
        self.uppers, self.schemes = [1], []
        while self.uppers[-1] < top:
            u = self.uppers[-1]
            self.uppers.append(max(u + 1, u * 100 // percent))
        self.uppers.append(max(self.uppers[-1] + 1, self.uppers[-1] * 100 // percent))
        for u in self.uppers:
            # |A - B| + |B - A| <= (|A| + |B|) (1 - t) / (1 + t)
            k = 2 * u * (100 - percent) // (100 + percent)
            if k <= 4:
                self.schemes.append((k, 1, k + 2 if k else 1, k, 0))
            else:
                n1 = k // 2 + 1
                risk = 3 * n1 * exp(-2 / 3 * u * percent / 100 / n1)
                spare = int(risk + 4 * sqrt(risk)) + 1
                self.schemes.append((k, n1 + spare, 3, 1, spare))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.uppers, sizes)


def signatures(h: np.ndarray, doc: np.ndarray, sizes: np.ndarray, bands: Bands):
    """(signature, document) pairs of the sets of a slice, for each own band and the next."""
    own = bands.of(sizes)
    scheme = np.array(bands.schemes)
    for up in (0, 1):
        band = np.minimum(own + up, len(scheme) - 1)
        for n2, k2 in sorted({(int(a), int(b)) for a, b in scheme[np.unique(band[sizes > 0])][:, [2, 3]]}):
            if not k2:
                continue  # differences are impossible: only equal sets link
            mine = (sizes > 0) & (scheme[band, 2] == n2) & (scheme[band, 3] == k2)
            if not mine.any():
                continue
            n1 = np.where(mine, scheme[band, 1], 0)
            base = np.cumsum(n1) - n1
            some = mine[doc]
            e, d = h[some], doc[some]
            x = r.mix(e + band[d].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            part = base[d] + ((x >> np.uint64(34)) % n1[d].astype(np.uint64)).astype(np.int64)
            cell = part * n2 + ((x & np.uint64(0x3FFFFFFF)) % np.uint64(n2)).astype(np.int64)
            total = int(n1.sum())
            sums = np.zeros(total * n2, np.uint64)
            np.add.at(sums, cell, r.mix(e))
            full = (np.bincount(cell, minlength=total * n2) > 0).reshape(total, n2)
            sums = sums.reshape(total, n2)
            owner = np.repeat(np.arange(len(sizes)), n1)
            tag = r.mix(band[owner].astype(np.uint64) * np.uint64(1 << 32) + (np.arange(total) - base[owner]).astype(np.uint64))
            subsets = list(combinations(range(n2), n2 - k2))
            filled = [full[:, list(c)].any(1) for c in subsets]
            risky = ~np.logical_and.reduce(filled)
            # Sets with more risky parts than are spare send their empty projections too.
            sends_empty = (np.bincount(owner[risky], minlength=len(sizes)) > scheme[band, 4])[owner]
            for j, c in enumerate(subsets):
                keep = filled[j] | sends_empty
                sig = tag + np.uint64((j + 1) * r.BASE2 % 2**64)
                for i in c:
                    sig = r.mix(sig ^ sums[:, i])
                yield sig[keep], owner[keep]


GROUPS_SQL = "gid long, members array<long>"


def candidate_groups(entries: DataFrame, parts: int) -> DataFrame:
    """Distinct groups (gid, sorted members) of documents that share a signature."""

    def go(table: pa.Table) -> pa.Table:
        got = [r.unpack(x.as_buffer()) for x in table.column("blob")]
        h, i = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        order = np.argsort(h, kind="stable")
        hs = h[order]
        many = np.zeros(len(h), bool)
        same = hs[1:] == hs[:-1]
        many[1:] |= same
        many[:-1] |= same
        h, i = hs[many], i[order][many]
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
        h, i = h[new], i[new]
        starts, sizes = r.runs(h)
        if len(starts):
            gid = r.mix(np.add.reduceat(r.mix(i.view(np.uint64) + np.uint64(0x1234567)), starts) ^ sizes.astype(np.uint64)).view(np.int64)
            _, first = np.unique(gid, return_index=True)
            first = first[sizes[first] > 1]
        else:
            gid, first = np.zeros(0, np.int64), starts
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes[first])]), pa.int32()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(i[a : a + n] for a, n in zip(starts[first], sizes[first], strict=True))])),
        )
        del h, i, hs, order, many, same, new, got
        r.give_back()
        return pa.table([pa.array(gid[first]), lists], names=["gid", "members"])

    dealt = rep.regrouped(entries, parts, hash_bytes=7, merge=False)
    return dealt.groupBy("part").applyInArrow(go, GROUPS_SQL).groupBy("gid").agg(F.first("members").alias("members"))


def star_pairs(groups: DataFrame) -> DataFrame:
    """Distinct (a, b): each group's smallest id with the others."""
    return groups.select(F.col("members")[0].alias("a"), F.explode("members").alias("b")).filter("a <> b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose exact sets link, as (u, v)."""

    def go(batches):
        for batch in batches:
            sets = []
            for name in ("text_a", "text_b"):
                out = []
                one = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(name)], names=["i", "t"])
                for s in r.slices(one, "i", "t"):
                    h, doc = shingle_sets(s, k)
                    cuts = np.searchsorted(doc, np.arange(len(s.ids) + 1))
                    out += [h[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                sets.append(out)
            ok = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    side = [texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    return pairs.join(side[1], "b").join(side[0], "a").select("a", "b", "text_a", "text_b").mapInArrow(go, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every linked document, by alternating large-star and small-star steps."""
    edges = cluster.cut(links.filter("u <> v").distinct(), "op1-edges")
    mark, n = None, edges.count()
    while n:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("m", "u"))
        least = cluster.cut(least.select("u", "m", "c"), "op1-least")
        large = cluster.join_heavy(both, least, ["u"], "c", 2 * n).filter("v > u").select("v", F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("u", F.col("m").alias("v")).union(low.select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cluster.cut(small.filter("u <> v").distinct(), "op1-step")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cluster.drop(edges, least)
        edges = new
        if now == mark:
            break
        mark, n = now, now[0]
    return edges.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component_id"))


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, gap): the pairs whose sketches allow a link (no cell difference can exceed the sets' own), and the difference as a share of the sizes."""

    def go(batches):
        for batch in batches:
            a, b = (np.frombuffer(r.string_parts(batch.column(c))[0], np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sketch_a", "sketch_b"))
            x, y = (np.frombuffer(r.string_parts(batch.column(c))[0].tobytes(), np.uint64).reshape(-1, PARITY // 64) for c in ("parity_a", "parity_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            gap = np.maximum(np.abs(a - b).sum(1), np.bitwise_count(x ^ y).sum(1))
            ok = gap * (100 + percent) <= n * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(gap / n)], names=["a", "b", "gap"]).filter(pa.array(ok))

    side = [nodes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab"]
    both = pairs.join(side[1], "b").join(side[0], "a")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return both.filter(sizes).mapInArrow(go, "a long, b long, gap double").groupBy("a", "b").agg(F.min("gap").alias("gap"))


#: Members of a group that one task compares with as many others.
BLOCK = 2048


def left_pairs(groups: DataFrame, found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a group across components that may link, beyond those with its smallest id.

    Members outside a group's largest component are compared with all of it, a
    block of at most ``BLOCK`` of them with a block of the group in each task.
    """
    rows = groups.filter(F.size("members") > 2).select("gid", F.size("members").alias("m"), F.col("members")[0].alias("a"), F.explode("members").alias("doc_id"))
    rows = cluster.cut(rows.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")), "op1-members")
    parts = rows.groupBy("gid", "component_id").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    mixed = parts.groupBy("gid").agg(F.max_by("component_id", F.struct("n", "component_id")).alias("largest"), (F.max("m") - F.max("n")).alias("open"), F.max("m").alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    mixed = cluster.cut(mixed.select("gid", "largest", "open", "c"), "op1-mixed")
    total = mixed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    some = cluster.join_heavy(rows.drop("m"), mixed.withColumn("m", F.col("c")), ["gid"], "c", total).join(sketches.select("doc_id", "n_shingles", "parity"), "doc_id")
    # Open members lie in the left blocks of their group, all members in the right ones; every pair of blocks is a task.
    lefts, rights = (F.ceil(F.col(x) / F.lit(BLOCK)).cast("int") for x in ("open", "m"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    is_open = (F.col("component_id") != F.col("largest")) & (F.col("doc_id") != F.col("a"))
    spots = F.concat(
        F.transform(F.sequence(F.lit(0), lefts - 1), lambda i: F.struct(i.alias("i"), place(rights).alias("j"), F.lit(False).alias("left"))),
        F.when(is_open, F.transform(F.sequence(F.lit(0), rights - 1), lambda j: F.struct(place(lefts).alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")),
    )
    dealt = some.select("gid", "a", "doc_id", "component_id", "n_shingles", "parity", F.explode(spots).alias("s")).select("*", "s.*").drop("s")

    def go(table: pa.Table) -> pa.Table:
        ids, comp, size, left = (table.column(c).to_numpy() for c in ("doc_id", "component_id", "n_shingles", "left"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        star = table.column("a")[0].as_py()
        out = [np.zeros((0, 2), np.int64)]
        right = np.flatnonzero(~left & (ids != star))
        ids_r, comp_r, size_r, bits_r = ids[right], comp[right], size[right], bits[right]
        for j in np.flatnonzero(left):
            ok = np.flatnonzero(comp_r != comp[j])
            gap = np.bitwise_count(bits_r[ok] ^ bits[j]).sum(1, dtype=np.int64)
            b = ids_r[ok][gap * (100 + percent) <= (size_r[ok] + size[j]) * (100 - percent)]
            out.append(np.stack([np.minimum(ids[j], b), np.maximum(ids[j], b)], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.groupBy("gid", "i", "j").applyInArrow(go, "a long, b long").distinct()


NODES_SQL = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, parity binary"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): near duplicates at ``percent`` hundredths of Jaccard similarity or more."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def summarise(batches):
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                h, doc = shingle_sets(s, shingle)
                n = len(s.ids)
                sums = np.zeros((2, n), np.uint64)
                np.add.at(sums[0], doc, r.mix(h))
                np.add.at(sums[1], doc, r.mix(h ^ np.uint64(r.BASE)))
                cells = np.bincount(doc * SKETCH + (h >> np.uint64(56)).astype(np.int64), minlength=n * SKETCH)
                sketch = np.minimum(cells, 255).astype(np.uint8).reshape(n, SKETCH)
                fine = np.bincount(doc * PARITY + ((h >> np.uint64(20)) % np.uint64(PARITY)).astype(np.int64), minlength=n * PARITY)
                parity = np.packbits((fine & 1).astype(np.uint8).reshape(n, PARITY), axis=1)
                yield pa.record_batch([
                    batch.column("doc_id").slice(s.rows.start, n), pa.array(np.bincount(doc, minlength=n)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in parity], pa.binary()),
                ], names=["doc_id", "n_shingles", "h1", "h2", "sketch", "parity"])

    nodes = cluster.cut(docs.mapInArrow(summarise, NODES_SQL), "op1-nodes")
    live = nodes.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    top = live.agg(F.max("n_shingles"), F.sum("n_shingles"), F.count(F.lit(1))).first()
    bands = Bands(percent, int(top[0] or 1))
    keys = ["n_shingles", "h1", "h2"]
    classes = cluster.cut(live.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "op1-classes")
    narrow = live.select("doc_id", *keys)
    same = cluster.cut(cluster.join_heavy(narrow, classes, keys, "c", top[2]).filter("doc_id > rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "op1-same")
    many_sets = cluster.cut(live.groupBy("doc_id").agg(F.count_distinct(*keys).alias("c")).filter("c > 1").select("doc_id"), "op1-several")
    copies = same.select(F.col("u").alias("doc_id")).distinct().join(many_sets, "doc_id", "left_anti")
    distinct = docs.filter("doc_id IS NOT NULL").join(cluster.sized(copies, 64), "doc_id", "left_anti")
    parts = cluster.prime(max(13, int(top[1] or 0) // rep.PER_PARTITION))

    width = rep.group_width(parts)

    def sign(batches):
        out = rep.Sender(parts, hash_bytes=7, merge=False, width=width)
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                h, doc = shingle_sets(s, shingle)
                for sig, owner in signatures(h, doc, np.bincount(doc, minlength=len(s.ids)), bands):
                    out.add(sig, r.mix(sig + np.uint64(1)), s.ids[owner], np.zeros(len(sig), np.int64))
                    yield from out.rows()
        yield from out.rows(last=True)

    groups = cluster.cut(candidate_groups(distinct.mapInArrow(sign, rep.ENTRIES_SQL), parts), "op1-groups")
    outlines = live.select("doc_id", "n_shingles", "sketch", "parity")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = distinct.join(cluster.sized(ids, 64), "doc_id", "left_semi")
        return cluster.cut(verified(pairs.select("a", "b"), texts, shingle, percent), f"op1-{name}")

    links = linked(cluster.cut(near(star_pairs(groups), outlines, percent), "op1-near"), "stars")
    found = cluster.cut(components(links), "op1-found")
    left = cluster.cut(near(left_pairs(groups, found, outlines, percent), outlines, percent), "op1-left")
    # The closest pairs of two components first: once these link, the others say nothing new.
    for turn, most in enumerate((2, 32, None)):
        side = [found.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"c_{c}")) for c in "ab"]
        open_ = left.join(side[0], "a", "left").join(side[1], "b", "left").withColumn("x", F.coalesce("c_a", "a")).withColumn("y", F.coalesce("c_b", "b")).filter("x <> y")
        if most is not None:
            w = Window.partitionBy(F.least("x", "y"), F.greatest("x", "y")).orderBy("gap", "a", "b")
            open_ = open_.withColumn("rn", F.row_number().over(w)).filter(f"rn <= {most}")
        open_ = cluster.cut(open_.select("a", "b", "gap"), "op1-open")
        if not open_.limit(1).count():
            break
        links = links.union(linked(open_, f"turn{turn}"))
        if most is not None:
            left = cluster.cut(left.join(open_.select("a", "b"), ["a", "b"], "left_anti"), "op1-left")
            found = cluster.cut(components(links), "op1-found")
    # A copy of one set alone follows its class; only ids of several sets tie classes together.
    ties = same.join(many_sets.select(F.col("doc_id").alias("u")), "u", "left_semi").select("u", "v")
    final = cluster.cut(components(links.union(ties)), "op1-final")
    of_class = classes.join(final.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*keys, F.coalesce("component_id", "rep").alias("component_id"), "c")
    members = cluster.join_heavy(narrow, cluster.cut(of_class, "op1-of-class"), keys, "c", top[2]).select("doc_id", "component_id")
    every = cluster.cut(final.union(members).groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "op1-every")
    cluster.drop(groups)
    return nodes.join(every, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
