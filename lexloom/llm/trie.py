r"""Prefix trie of conversations by polynomial rolling prefix fingerprints.

Turns are ordered by (turn, role, text), nulls first and null texts as ''.
Rows are sorted once over all partitions, and a place in a conversation is its
place in the partition plus the counts of the partitions before, so that no
task holds a conversation.  :func:`rebuild` gives every conversation the first
turns of its block's head; :func:`trie` takes any table of (conv_id, depth,
role, text).

The fingerprint of the first d turns is the sum of mix(hash(turn i)) * B^i
modulo 2^64, a numpy scan of chunks of 4,096 turns on top of the sums of the
chunks before.  Conversations of one fingerprint at one depth are a candidate
group.  It is verified turn by turn: a task compares the least and the greatest
(fingerprint before, role, text) of its members, and where the two differ,
members that differ from the group's representative, its smallest conversation,
get another fingerprint from that depth on, until no group differs.  As the
fingerprint before is compared too, members of a verified group share all turns.

The rollup to the parents needs no round for each depth: a conversation owns
the nodes whose smallest member it is, which lie at the end of its path, and a
node's subtree sums are its owner's sum from there on plus the whole owned sums
of its other members.

Edge cases: rows with a null conv_id belong to no conversation and are left
out; null roles and texts are empty; repeated rows are turns of their own; a
conversation that is rebuilt without turns ends at the root; an empty table
has no members and gives no rows.  Only the four named columns are read, so
others may have any name.  A turn's text is held whole, a conversation never;
the ids that end at one node pass through one task, a batch at a time, since
SHA-256 reads them in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import rolling as r

#: Turns of one chunk of a scan.
CHUNK = 4096
#: Conversations of a block, of which the first lends its head, and the head's most turns plus one.
BLOCK, HEAD = 5, 9


def _word(bits: int) -> Column:
    """2 to the power of ``bits`` as an exact decimal."""
    return F.lit(str(2**bits)).cast("decimal(38,0)")


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, nth, role, text): turns numbered from 1 in the order of their conversation, without a task for a whole one."""
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    sort = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")

    def number(batches):
        last, seen = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts, sizes = r.runs(ids)
            nth = np.arange(len(ids)) - np.repeat(starts, sizes) + 1
            if ids[0] == last:
                nth[: sizes[0]] += seen
            last, seen = ids[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(nth, pa.int64()), batch.column("role"), batch.column("text")], names=["part", "conv_id", "nth", "role", "text"])

    local = cluster.cut(sort.mapInArrow(number, "part int, conv_id long, nth long, role string, text string"), "op12-sorted")
    counts = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("before > 0").select("conv_id", "part", "before")
    # Only a conversation that goes over a partition's end has turns before: a row or two for each partition.
    return local.join(cluster.sized(cluster.cut(before, "op12-before"), 48), ["conv_id", "part"], "left").select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "role", "text")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, role, text), (conv_id, length)): the head of the block's first conversation, then a conversation's own turns after as many."""
    head = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEAD).alias("head")
    turns = cluster.cut(turns, "op12-turns")
    sizes = turns.groupBy("conv_id").agg(F.max("nth").alias("own")).select("conv_id", "own", head, (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = cluster.cut(sizes.join(lent, "base", "left").select("conv_id", "own", "head", "base", F.least("head", F.coalesce("base_own", F.lit(0))).alias("taken")), "op12-convs")
    heads = turns.filter(F.col("nth") < HEAD).join(convs.select(F.col("base").alias("base_id"), F.col("conv_id").alias("to"), "taken"), (F.col("conv_id") == F.col("base_id")) & (F.col("nth") <= F.col("taken")))
    # A conversation may hold a third of all rows: its first HEAD - 1 turns are dropped where they are, and only those of many turns need its row.
    tails = cluster.join_heavy(turns, convs.select("conv_id", "head", "taken", "own"), ["conv_id"], "own", int(convs.agg(F.sum("own")).first()[0] or 0)).filter("nth > head")
    rows = heads.select(F.col("to").alias("conv_id"), F.col("nth").alias("depth"), "role", "text").unionByName(tails.select("conv_id", (F.col("nth") - F.col("head") + F.col("taken")).alias("depth"), "role", "text"))
    return rows, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))


def _powers(first: np.ndarray) -> np.ndarray:
    """B^(first + k) is the power of the chunk's first turn times B^k."""
    some, code = np.unique(first, return_inverse=True)
    return np.array([pow(r.BASE, int(x), 1 << 64) for x in some], np.uint64)[code]


def terms(h: np.ndarray, depth: np.ndarray) -> np.ndarray:
    up = r.POWERS.upto(CHUNK)[0]
    return r.mix(h) * _powers(depth - depth % CHUNK) * up[depth % CHUNK]


def prefixes(rows: DataFrame, bits: int) -> DataFrame:
    """(conv_id, depth, fp, before, role, text): the fingerprint of the first ``depth`` turns and of one less."""
    marked = rows.select("conv_id", "depth", (F.col("depth") / CHUNK).cast("long").alias("chunk"), "role", "text", F.xxhash64("role", "text").alias("h"))

    def segments(batch, last):
        """Starts of the (conversation, chunk) runs of a sorted batch, and whether its first one goes on from ``last``."""
        conv, chunk = batch.column("conv_id").to_numpy(), batch.column("chunk").to_numpy()
        new = np.ones(len(conv), bool)
        new[1:] = (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])
        return np.flatnonzero(new), (conv[0], chunk[0]) == last, (conv[-1], chunk[-1])

    def value(batch):
        h = batch.column("h").to_numpy().view(np.uint64)
        return terms(h & np.uint64((1 << bits) - 1), batch.column("depth").to_numpy())

    def scan(batches):
        last, total = None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, goes_on, last = segments(batch, last)
            t = value(batch)
            base = batch.column("base").to_numpy().view(np.uint64)[starts].copy()
            sums = np.cumsum(t)
            sizes = np.diff(np.append(starts, len(t)))
            if goes_on:
                base[0] = total
            fp = sums + np.repeat(base - (sums[starts] - t[starts]), sizes)
            total = fp[-1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(fp.view(np.int64)), pa.array((fp - t).view(np.int64)), batch.column("role"), batch.column("text")], names=["conv_id", "depth", "fp", "before", "role", "text"])

    def chunk_sums(batches):
        for batch in batches:
            if batch.num_rows:
                t = value(batch)
                starts = segments(batch, None)[0]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(starts)), batch.column("chunk").take(pa.array(starts)), pa.array(np.add.reduceat(t, starts).view(np.int64))], names=["conv_id", "chunk", "s"])

    # Sums of whole chunks exist only for conversations of more than CHUNK turns: a row for CHUNK of their turns.
    long_ones = marked.filter(F.col("depth") >= CHUNK).select("conv_id").distinct()
    light = marked.select("conv_id", "depth", "chunk", "h")
    sums = light.join(cluster.sized(cluster.cut(long_ones, "op12-long"), 32), "conv_id", "left_semi").mapInArrow(chunk_sums, "conv_id long, chunk long, s long")
    word = F.col("s").cast("decimal(38,0)")
    total = sums.groupBy("conv_id", "chunk").agg(F.sum(F.expr("CAST(s AS DECIMAL(20,0))")).cast("decimal(38,0)").alias("s")).withColumn("s", F.pmod(word, _word(64)))
    upto = F.pmod(F.sum("s").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), _word(64))
    bases = total.withColumn("upto", upto).select("conv_id", "chunk", F.when(F.col("upto") >= _word(63), F.col("upto") - _word(64)).otherwise(F.col("upto")).cast("long").alias("base")).filter("base IS NOT NULL")
    whole = marked.join(cluster.sized(cluster.cut(bases, "op12-bases"), 48), ["conv_id", "chunk"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    by_chunk = whole.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "depth")
    return by_chunk.select("conv_id", "depth", "chunk", "base", "h", "role", "text").mapInArrow(scan, "conv_id long, depth long, fp long, before long, role string, text string")


def verified(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes): fingerprints that tell all different prefixes apart, and (depth, fp, conv_id, n_convs, before, bytes) of each group."""
    turn = 0
    while True:
        groups = paths.groupBy("depth", "fp").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("before", "role", "text")).alias("least"), F.max(F.struct("before", "role", "text")).alias("most"),
        )
        nodes = cluster.cut(groups.select("depth", "fp", "conv_id", "n_convs", F.col("least.before").alias("before"), F.octet_length("least.text").cast("long").alias("bytes"), (F.col("least") != F.col("most")).alias("split")), "op12-nodes")
        if nodes.filter("split").isEmpty():
            return paths, nodes
        bad = nodes.filter("split").select("depth", "fp", F.col("conv_id").alias("head"))
        members = cluster.cut(paths.join(bad, ["depth", "fp"]), "op12-bad")
        heads = members.filter("conv_id = head").select("depth", "fp", F.struct("before", "role", "text").alias("theirs"))
        other = members.join(heads, ["depth", "fp"]).filter(F.struct("before", "role", "text") != F.col("theirs"))
        turn += 1
        moved = other.groupBy("conv_id").agg(F.min(F.struct("depth", F.xxhash64("before", "role", "text", F.lit(turn)).alias("by"))).alias("x")).select("conv_id", "x.depth", "x.by")
        moved = cluster.cut(moved.withColumnRenamed("depth", "from"), "op12-moved")
        at = F.col("from").isNotNull() & (F.col("depth") >= F.col("from"))
        before = F.col("from").isNotNull() & (F.col("depth") > F.col("from"))
        paths = cluster.cut(paths.join(moved, "conv_id", "left").select(
            "conv_id", "depth", F.when(at, F.col("fp").bitwiseXOR(F.col("by"))).otherwise(F.col("fp")).alias("fp"), F.when(before, F.col("before").bitwiseXOR(F.col("by"))).otherwise(F.col("before")).alias("before"), "role", "text",
        ), "op12-paths")


def ends(last: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256): digest of the ids that end at each node, ascending and comma-joined, read a batch at a time."""

    def digest(batches):
        now, state = None, None
        for batch in batches:
            depth, fp, conv = (batch.column(c).to_numpy() for c in ("depth", "fp", "conv_id"))
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])
            starts = np.flatnonzero(new)
            done = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)], strict=True):
                text = ",".join(map(str, conv[a:b].tolist())).encode()
                key = (int(depth[a]), int(fp[a]))
                if key == now:
                    state.update(b"," + text)
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text)
            yield _ends_rows(done)
        if now is not None:
            yield _ends_rows([(*now, state.hexdigest())])

    return last.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(digest, "depth long, fp long, ends_sha256 string")


def _ends_rows(done: list[tuple]) -> pa.RecordBatch:
    depth, fp, sha = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha, pa.string())], names=["depth", "fp", "ends_sha256"])


def owned_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``below``, the sum of (n_convs - 1) * bytes over the owner's nodes from this one on."""
    value = ((F.col("n_convs") - 1) * F.col("bytes")).alias("v")
    chunked = nodes.select("*", value, (F.col("depth") / CHUNK).cast("long").alias("chunk"))
    sums = cluster.cut(chunked.groupBy("conv_id", "chunk").agg(F.sum("v").alias("s")).withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).filter("chunks > 1"), "op12-chunks")
    after = sums.withColumn("after", F.sum("s").over(Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))).select("conv_id", "chunk", F.coalesce("after", F.lit(0)).alias("after"))
    inner = F.sum("v").over(Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return chunked.withColumn("inner", inner).join(cluster.sized(cluster.cut(after, "op12-after"), 48), ["conv_id", "chunk"], "left").withColumn("below", F.col("inner") + F.coalesce("after", F.lit(0))).drop("v", "chunk", "inner", "after")


def trie(rows: DataFrame, lengths: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``rows`` is (conv_id, depth from 1, role, text) and ``lengths`` (conv_id,
    length) holds every conversation, turnless ones too.  ``bits`` keeps only so
    many bits of a turn's hash, to try the splitting of collisions.
    """
    paths, below = verified(cluster.cut(prefixes(rows, bits), "op12-paths"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), "conv_id", "n_convs", F.lit(None).cast("long").alias("before"), F.lit(0).cast("long").alias("bytes"))
    nodes = below.drop("split").unionByName(root)
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cluster.cut(nodes.join(children, ["depth", "fp"], "left").na.fill(0, ["n_children"]), "op12-counted")
    owners = counted.groupBy("conv_id").agg(F.min("depth").alias("first"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owners = cluster.cut(owners, "op12-owners")
    light = paths.select("conv_id", "depth", "fp")
    every = light.unionByName(lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp")))
    lent = every.join(owners.filter("owned > 0 OR leaf > 0"), "conv_id").filter("depth < first").groupBy("depth", "fp").agg(F.sum("owned").alias("others"), F.sum("leaf").alias("leaves"))
    last = every.join(lengths, "conv_id").filter("depth = length").select("depth", "fp", "conv_id")
    sums = owned_sums(counted).join(owners.select("conv_id", "leaf"), "conv_id").join(lent, ["depth", "fp"], "left").join(ends(last), ["depth", "fp"], "left")
    whole = cluster.cut(sums.select(
        "conv_id", "depth", "fp", "before", "n_convs", "n_children", (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.col("below") + F.coalesce("others", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ), "op12-whole")
    total = whole.agg(F.sum("n_children")).first()[0] or 1
    parents = whole.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = cluster.join_heavy(whole.filter("depth > 0").drop("n_children").join(whole.select("depth", "fp", "n_children"), ["depth", "fp"]), parents.withColumnRenamed("n_children", "rows"), ["depth", "before"], "rows", total)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.select(*columns).unionByName(whole.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns``."""
    return trie(*rebuild(ordered(turns)))
