"""The prefix trie against a dictionary of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import trie


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def expected(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in sorted(paths.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, cs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(cs) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted((cs[0], len(k), members[k[:-1]][0] if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()) for k, cs in members.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-7, 40), *range(1000, 1030)]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None, "long " * 9])))
    out += [(2000 + c, t, "system", "same") for c in range(40) for t in range(3)]  # copies
    out += [(5, 1, "user", "again")] * 3 + [(None, 1, "user", "nobody's")] + [(77, t, "user", f"hot {t % 5}") for t in range(200)]
    rng.shuffle(out)
    return out


def run(spark, rows):
    table = spark.createDataFrame([(*x, 1, "x", 0.5) for x in rows], "conv_id long, turn long, role string, text string, depth int, fp string, before double").repartition(5)
    return table


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(x) for x in df.collect())


def test_nulls_ties_copies_and_a_hot_conversation(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)  # every scan goes over many chunks
    assert result(trie.conversation_trie(run(spark, rows))) == expected(rebuilt(rows))


def test_collisions_are_split(spark, rows, bits=2):
    few = [x for x in rows if x[0] is not None and (x[0] < 12 or x[0] >= 2030)]
    built, lengths = trie.rebuild(trie.ordered(run(spark, few)))
    assert result(trie.trie(built, lengths, bits=bits)) == expected(rebuilt(few))


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert result(trie.conversation_trie(empty)) == []
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    table = spark.createDataFrame([(lone, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert result(trie.conversation_trie(table)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_order_does_not_depend_on_partitions(spark):
    table = spark.range(20000).select(F.lit(1).alias("conv_id"), (F.col("id") % 7000).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = trie.ordered(table.repartition(9)).orderBy("nth").collect()
    assert [x["nth"] for x in got] == list(range(1, 20001))
    assert [x["text"] for x in got] == [str(i) for i in sorted(range(20000), key=lambda i: (i % 7000, str(i)))]
