"""Batches of queries against blocks of documents: the same hits as plain Python, however documents, queries and terms are dealt."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.operators import index as IX
from lexloom.operators import retrieval as V

WORDS = [f"w{i}" for i in range(40)]


def texts(n, seed, least=0, most=30):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(WORDS) + 1)
    return [" ".join(rng.choice(WORDS, rng.integers(least, most), p=share / share.sum())) for _ in range(n)]


def brute(docs, queries, k, allowed=None):
    """(qid, id, score to nine places, rank) of BM25 over the words of the texts."""
    held = {i: Counter(t.split()) for i, t in docs}
    n, df = len(held), Counter(w for c in held.values() for w in c)
    mean = sum(sum(c.values()) for c in held.values()) / n
    out = []
    for qid, text in queries:
        found = []
        for i, c in held.items():
            ws = set(text.split()) & set(c)
            if ws and (allowed is None or i in allowed):
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                found.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in ws), 9), i))
        out += [(qid, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def same(got, want):
    got = sorted((r.qid, r["rank"], r.id, r.score) for r in got)
    want = sorted((q, r, i, s) for q, i, s, r in want)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-8)


@pytest.mark.parametrize("name", ["long", "string"])
def test_blocks_and_passes_find_what_plain_python_finds(spark, tmp_path, monkeypatch, name):
    """Copies tie by id across blocks; queries go in several passes of few queries each."""
    monkeypatch.setattr(IX, "BLOCK_POSTINGS", 900)
    monkeypatch.setattr(IX, "LEAST_POSTINGS", 50)
    monkeypatch.setattr(V, "BROADCAST_BYTES", 4000)
    ids = [i * 7 % 1009 for i in range(300)]
    own = ids if name == "long" else [f"d{i}" for i in ids]
    some = texts(200, 1)
    docs = list(zip(own, some + some[:100], strict=True))
    queries = list(enumerate(texts(60, 2, 1, 12))) + [(60, "nowhere"), (61, ""), (62, "w0")]
    ix = IX.build(spark.createDataFrame(docs, f"doc_id {name}, text string"), str(tmp_path))
    asked = spark.createDataFrame(queries, "qid int, query string")
    found = IX.search(ix, asked, 7)
    same(found.collect(), brute(docs, queries, 7))
    allowed = set(own[::3])
    same(IX.search(ix, asked, 7, allowed=spark.createDataFrame([(i,) for i in allowed for _ in (0, 1)], f"id {name}")).collect(), brute(docs, queries, 7, allowed))


def test_a_task_scores_queries_in_chunks(monkeypatch):
    """Groups of maxima keep every tie, and neither the chunk nor the matrix changes a hit."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(int(i), int(s), float(v)) for i in range(1000) for s, v in zip(rng.choice(50, 9, replace=False) * 11, rng.integers(1, 4, 9) / 4, strict=True)]
    asks = [sorted(rng.choice(60, 8, replace=False) * 11) for _ in range(33)]
    batch = pa.table({"id": [r[0] for r in rows], "slot": [r[1] for r in rows], "impact": [r[2] for r in rows]}).to_batches(max_chunksize=700)
    held = blocks.Asked(pa.table({"slots": pa.array(asks, pa.list_(pa.int64())), "qno": pa.array(range(100, 133), pa.int64())}))
    want = []
    for n, a in enumerate(asks):
        sums = Counter()
        for i, s, v in rows:
            if s in a:
                sums[i] += v
        want += [(100 + n, i, v) for i, v in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:5]]
    for score, dense, share in ((1, 1 << 20, 0.0), (1 << 20, 1 << 20, 0.01), (1 << 20, 0, 0.0)):
        monkeypatch.setattr(blocks, "SCORE_BYTES", score)
        monkeypatch.setattr(blocks, "DENSE_BYTES", dense)
        monkeypatch.setattr(blocks, "DENSE_SHARE", share)
        got = [r for b in blocks.best(iter(batch), held, 5) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == want


def test_hits_are_searched_once_and_no_row_stands_for_a_query_a_term_and_a_document(spark, tmp_path):
    """What reads the hits reads written rows; of the postings one row each is dealt out, whatever the number of queries."""
    docs = [(i, "common " + t) for i, t in enumerate(texts(100, 4))]
    ix = IX.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    found = IX.search(ix, spark.createDataFrame([(i, "common w0 w1") for i in range(200)], "qid int, query string"), 3)
    assert found.count() == 600 and found.inputFiles() and all("bm25-hits" in f for f in found.inputFiles())
    assert found.select(F.countDistinct("id")).first()[0] == 3


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    """The same rows as by groups, whatever is counted at once; documents without words have none."""
    monkeypatch.setattr(blocks, "TOKENS", 40)
    docs = spark.createDataFrame([*enumerate(texts(50, 5, 0, 90)), (50, None), (51, "")], "doc_id long, text string").withColumn("title", F.substring("text", 1, 9))
    fields = {"content": "text", "title": "title"}
    got = IX.counted(docs, "doc_id", fields, 8)
    want = IX.postings_of(docs, "doc_id", fields, 8)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_the_similarities_of_some_queries_at_a_time(spark, monkeypatch):
    """However many queries there are, no product is larger than SCORE_BYTES; the hits are the same."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    q = v.filter("id < 300").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    want = sorted(map(tuple, V.vector_search(v, q, 5).withColumn("score", F.round("score", 9)).collect()))
    most, best = 20_000, V._best

    def small(s, ids, k):
        assert s.nbytes <= most
        return best(s, ids, k)

    monkeypatch.setattr(V, "SCORE_BYTES", most)
    seen, given = [], type(v).mapInArrow
    monkeypatch.setattr(V, "_best", small)
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, go, schema, **more: (seen.append(go), given(self, go, schema, **more))[1])
    V.vector_search(v, q, 5)
    out = [b for go in seen for b in go(iter(v.toArrow().to_batches()))]
    assert len(out) == 50 and sum(b.num_rows for b in out) == 300 * 5
    monkeypatch.undo()
    monkeypatch.setattr(V, "SCORE_BYTES", most)
    assert sorted(map(tuple, V.vector_search(v, q, 5).withColumn("score", F.round("score", 9)).collect())) == want


def test_a_stored_row_lists_many_documents_of_a_term(spark, tmp_path):
    """Sums of a list stand beside it, and a search joins lists with its terms before it unfolds them."""
    docs = [(i, "common " + t) for i, t in enumerate(texts(100, 7))]
    ix = IX.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), str(tmp_path))
    row = ix.lists.filter("term = 'common'").collect()
    assert len(row) == 1 and row[0].n == 100 and row[0].cf == 100 and sorted(row[0].id) == list(range(100))
    assert ix.lists.count() <= 41 and ix.postings.count() == sum(len(set(t.split())) for _, t in docs)
    found = IX.search(ix, spark.createDataFrame([(0, "common w1"), (1, "w39 w2")], "qid int, query string"), 9)
    same(found.collect(), brute(docs, [(0, "common w1"), (1, "w39 w2")], 9))


def test_lists_are_dealt_in_pieces_and_not_as_rows(spark, tmp_path, monkeypatch):
    """A task sends a row for each block of documents, whatever the postings of its lists; a document's are in one block, and hits are the same."""
    import pyarrow as pa

    for ids in ([*range(500)], [f"d{i}" for i in range(500)]):
        batch = pa.RecordBatch.from_pylist([{"id": ids[s:], "tf": [1] * (500 - s), "len": [5] * (500 - s), "slot": s, "idf": 1.5, "avg_len": 4.0} for s in range(9)])
        pieces = list(blocks.deal(iter([batch]), 4))
        assert sum(p.num_rows for p in pieces) == 4
        held = [[r for b in blocks.dealt(iter([p])) for r in b.to_pylist()] for p in pieces]
        assert sum(map(len, held)) == sum(500 - s for s in range(9)) and sum(len({r["id"] for r in h}) for h in held) == 500
        assert all(abs(r["impact"] - 1.5 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / 4))) < 1e-12 for h in held for r in h)
    monkeypatch.setattr(IX, "LEAST_POSTINGS", 50)
    docs = [(i, "common " + t) for i, t in enumerate(texts(300, 8))]
    ix = IX.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    queries = [(i, "common " + t) for i, t in enumerate(texts(20, 9, 1, 8))]
    same(IX.search(ix, spark.createDataFrame(queries, "qid int, query string"), 6).collect(), brute(docs, queries, 6))


def test_documents_are_counted_at_once_whatever_batches_they_come_in():
    import pyarrow as pa

    rows = pa.table({"id": [*range(12)], "field": ["content"] * 12, "text": ["a b", "", None, "b"] * 3})
    found = [r for b in blocks.count_terms(iter(rows.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert {r["term"]: (r["n"], r["cf"], sorted(r["id"])) for r in found} == {"a": (3, 3, [0, 4, 8]), "b": (6, 6, [0, 3, 4, 7, 8, 11])} and len(found) == 2


def test_words_cut_from_bytes_are_the_pattern_s():
    """Every edge of the class in every length of UTF-8, at the edges of texts, in slices."""
    import re

    import pyarrow as pa

    from lexloom.functions import text as T

    edges = [chr(c) for c in (0, 32, 45, 48, 65, 95, 97, 0x7F, 0x80, 0xBF, 0xC0, 0xD7, 0x110, 0x7FF, 0x800, 0xFFF, 0x1000, 0x1EBF, 0x1EC0, 0x1EF9, 0x1EFA, 0x1FFF, 0x2000, 0x4E2D, 0xFFFF, 0x10000, 0x1F600)]
    rng = np.random.default_rng(10)
    own = ["".join(rng.choice(edges, rng.integers(0, 30))) for _ in range(2000)] + ["", None, "ab", "c", " "]
    for skip in (0, 7, len(own) - 1, len(own)):
        found, n = blocks._words(pa.array(own, pa.large_string()).slice(skip))
        want = [re.findall(T.WORD, x or "") for x in own[skip:]]
        assert found.to_pylist() == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]


def test_lists_are_shuffled_in_pieces_and_merged(spark, tmp_path, monkeypatch):
    """A term's documents that were counted at many times are one stored row, and hot terms go to several partitions, without a row lost."""
    monkeypatch.setattr(blocks, "TOKENS", 40)
    docs = spark.createDataFrame([(i, f"common w{i % 7} d{i}" if i % 10 else None) for i in range(300)], "doc_id long, text string").repartition(3)
    fields = {"content": "text"}
    ix = IX.build(docs, str(tmp_path / "one"))
    assert ix.lists.count() == ix.lists.select("bucket", "term", "field").distinct().count() == 1 + 7 + 270
    plan = IX.gathered(docs, "doc_id", fields, 4, 8, 300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shuffle_partition_id(part") == 1 and plan.count("Exchange") == 2  # the other deals out the rows above
    want = sorted(map(tuple, IX.postings_of(docs, "doc_id", fields, 4).collect()))
    for sent, hot in ((blocks.SENT, 300), (16, 300), (16, 50)):
        monkeypatch.setattr(blocks, "SENT", sent)
        monkeypatch.setattr(IX, "HOT_ROWS", hot)
        got = IX.gathered(docs, "doc_id", fields, 4, 8, 300).withColumn("part", F.spark_partition_id())
        assert sorted(map(tuple, IX.unfolded(got, "bucket", "term", "field").collect())) == want
        assert {r.b for r in got.select((F.col("part") % 4 == F.col("bucket")).alias("b")).collect()} == ({True} if hot == 300 else {True, False})
        assert (got.filter("term = 'common'").select("part").distinct().count() > 1) == (hot == 50)
    index = spark.createDataFrame([(0, "common w3 d3")], "qid long, query string")
    assert IX.search(ix, index, 1).first().id == 3


def test_an_index_of_another_hash_is_refused(spark, tmp_path):
    IX.Store(spark, str(tmp_path)).commit({}, None, {"kind": "bm25", "buckets": 1, "id": "doc_id", "fields": {"content": "text"}})
    with pytest.raises(ValueError, match="older release"):
        IX.read(spark, str(tmp_path))
    with pytest.raises(ValueError, match="older release"):
        IX.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path))
