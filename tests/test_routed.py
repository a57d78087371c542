"""The routed search on a small corpus: what each route, gate and fallback does, and its stages by plain Python."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.operators import index as IX
from lexloom.operators import routed
from lexloom.operators import routing as RT

LAND, DECREE, LABOUR, LOCAL = "Luật Đất đai", "Nghị định 12/2022/NĐ-CP xử phạt lao động", "Bộ luật Lao động", "Quyết định UBND tỉnh"
CHUNKS = [
    ("l1", "L", LAND, "Điều 1", "1", "", "31/2024/QH15", "bồi thường khi thu hồi đất của hộ gia đình"), ("l2", "L", LAND, "Điều 2 > Khoản 1", "2", "1", "31/2024/QH15", "bồi thường về đất nông nghiệp"),
    ("l3", "L", LAND, "Điều 2 > Khoản 1", "2", "1", "31/2024/QH15", "bồi thường về đất nông nghiệp, bản chép"), ("n1", "N", DECREE, "Điều 5 > Khoản 1", "5", "1", "12/2022/NĐ-CP", "phạt tiền người sử dụng lao động không ký hợp đồng lao động"),
    ("n2", "N", DECREE, "Điều 5 > Khoản 2", "5", "2", "12/2022/NĐ-CP", "thẩm quyền xử phạt vi phạm hành chính của thanh tra lao động"), ("n3", "N", DECREE, "Điều 6", "6", "", "12/2022/NĐ-CP", "biện pháp khắc phục hậu quả"),
    ("b1", "B", LABOUR, "Điều 35", "35", "", "45/2019/QH14", "người lao động đơn phương chấm dứt hợp đồng lao động"), ("u1", "U", LOCAL, "Điều 1", "1", "", "80/2025/QĐ-UBND", "thu hồi đất trên địa bàn tỉnh, bồi thường"),
    ("s1", "S", "Luật Biển đảo", "", "", "", "", "chữ khác hẳn"),
]
QUERIES = [
    (1, "Khoản 2 Điều 5 Nghị định 12/2022/NĐ-CP quy định gì?"), (2, "Điều 9 Nghị định 99/2022/NĐ-CP phạt tiền"), (3, "Nội dung 80/2025/QĐ-UBND bồi thường"),
    (4, "Luật Đất đai quy định thế nào về bồi thường khi thu hồi đất"), (5, "Luật Rừng quy định thế nào về bồi thường khi thu hồi đất"), (6, "thẩm quyền xử phạt vi phạm hành chính của thanh tra"),
    (7, ""), (8, "Luật Biển đảo quy định thế nào về vịnh san hô"), (9, "đơn phương chấm dứt hợp đồng lao động"),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    chunks = spark.createDataFrame(CHUNKS, "id string, doc_id string, title string, path string, article string, clause string, document_number string, text string")
    ix = IX.build(chunks, str(tmp_path_factory.mktemp("ix")), "id")
    laws = chunks.select("doc_id", "title").distinct()
    return ix, chunks, laws, spark.createDataFrame(QUERIES, "qid int, query string")


@pytest.fixture(scope="module")
def found(spark, corpus):
    ix, chunks, laws, queries = corpus
    near = spark.createDataFrame([(6, "b1", 0.9), (6, "n2", 0.8), (4, "l2", 0.7), (4, "u1", 0.6), (5, "l1", 0.5), (3, "l1", 0.4), (1, "l1", 0.3)], "qid int, id string, score double")

    def vector(asks, k):
        rows = asks.join(near, "qid").join(chunks.select("id", "doc_id"), "id").filter("size(allowed) = 0 OR array_contains(allowed, doc_id)")
        from lexloom.operators.retrieval import top_k
        return top_k(rows.select("qid", "id", "score"), k)

    stages, decisions = routed.search(ix, queries, chunks, laws, vector, final_k=3)
    by = {}
    for r in stages.orderBy("qid", "stage", "rank", "id").collect():
        by.setdefault((r.qid, r.stage), []).append(r)
    return by, {r.qid: r for r in decisions.collect()}


def ids(found, qid, stage):
    return [r.id for r in found[0].get((qid, stage), [])]


def test_routes(found):
    d = found[1]
    assert {q: (r.initial_route, r.route) for q, r in d.items()} == {
        1: ("structured_exact",) * 2, 2: ("structured_exact", "narrow_bm25"), 3: ("narrow_bm25",) * 2, 4: ("law_anchored_hybrid", "exact_doc"), 5: ("law_anchored_hybrid", "loose"),
        6: ("hybrid_default",) * 2, 7: ("hybrid_default",) * 2, 8: ("law_anchored_hybrid", "candidate_docs"), 9: ("hybrid_default",) * 2,
    }
    assert (d[4].allowed, d[4].lookup_reason, d[5].allowed, d[5].lookup_reason) == (["L"], "exact_confidence_margin", [], "no_match")


def test_structured_lookup_answers_alone(found):
    assert ids(found, 1, "structured") == ["n2", "n1"] and ids(found, 1, "final")[0] == "n2" and not ids(found, 1, "bm25") and not ids(found, 1, "vector")
    assert found[1][1].vector_skipped == "structured_lookup" and found[1][1].n_structured == 2 and found[1][2].n_structured == 0 and ids(found, 2, "bm25")


def test_scope_and_vectors(found):
    assert set(ids(found, 4, "bm25")) <= {"l1", "l2", "l3"} and ids(found, 4, "vector") == ["l2"]
    assert found[1][3].vector_skipped == "route" and not ids(found, 3, "vector")
    assert {r.filter_reason for r in found[0][4, "filtered"]} == {"duplicate_legal_unit"} and len({"l2", "l3"} & set(ids(found, 4, "final"))) == 1


def test_exact_retry(found):
    """The one law of that name has none of the words: the search runs again over the lookup's documents, and says so."""
    d = found[1][8]
    assert (d.exact_retry, d.route, d.allowed, d.lookup_reason, d.n_final) == (True, "candidate_docs", ["S"], "exact_confidence_margin", 0)
    assert found[1][4].exact_retry is False


def test_empty_query(found):
    assert not [k for k in found[0] if k[0] == 7] and found[1][7].n_final == 0


def bm25(query, allowed, titles=False):
    words = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", s).lower()).split()]
    docs = {c[0]: words(c[7]) for c in CHUNKS}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, ws in docs.items():
        if allowed and next(c[1] for c in CHUNKS if c[0] == i) not in allowed:
            continue
        s = 0
        for w in {x for x in words(query) if len(x) > 1 or x.isdigit()}:
            df, tf = sum(w in d for d in docs.values()), ws.count(w)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        if s:
            out[i] = s
    return sorted(out, key=lambda i: (-round(out[i], 9), i))


def test_stages_by_plain_python(found):
    for qid, query in ((3, QUERIES[2][1]), (4, QUERIES[3][1]), (5, QUERIES[4][1])):
        hits = bm25(query, found[1][qid].allowed)
        assert ids(found, qid, "bm25") == hits
        near = ids(found, qid, "vector")
        scores = {}
        for ranked in (hits, near):
            for k, i in enumerate(ranked):
                scores[i] = scores.get(i, 0) + 1 / (60 + k)
        got = {r.id: r.score for r in found[0][qid, "rrf"]}
        assert set(got) == set(scores) and (not near or all(abs(got[i] - scores[i]) < 1e-12 for i in scores))
        units = {}
        for i in ids(found, qid, "rrf"):
            c = next(c for c in CHUNKS if c[0] == i)
            units.setdefault((c[1], c[4], c[5]), i)
        assert ids(found, qid, "deduped") == list(units.values())
        assert sorted(ids(found, qid, "reranked")) == sorted(units.values()) and ids(found, qid, "final") == ids(found, qid, "reranked")[:3]


def test_scope_fallback(spark, corpus):
    """A default query that its anchor scopes to a law without any of its words searches all chunks by the fallback text."""
    ix, chunks, laws, _ = corpus
    more = laws.unionByName(spark.createDataFrame([("X", "Cán bộ công chức")], "doc_id string, title string"))
    other = chunks.unionByName(spark.createDataFrame([("x1", "X", "Luật Cán bộ công chức", "", "", "", "", "khác")], chunks.schema))
    stages, decisions = routed.search(ix, spark.createDataFrame([(1, "công chức bị thu hồi đất được bồi thường")], "qid int, query string"), other, more)
    d = decisions.first()
    assert (d.scope_fallback, d.allowed, d.n_raw) == (True, [], 0) and d.fallback_reason
    assert {"l1", "u1"} & {r.id for r in stages.filter("stage = 'final'").collect()}


def test_law_lookup_by_rare_words(spark):
    """Titles share a word; only the rest of the name selects."""
    laws = spark.createDataFrame([(str(i), f"Luật số {i} chung") for i in range(300)] + [("a", "Luật Đất đai"), ("b", "Luật Đất đai sửa đổi")], "doc_id string, title string")
    q = spark.createDataFrame([(1, "luat dat dai"), (2, "luat bien"), (3, ""), (4, "luat dat dai sua")], "qid int, law_name string")
    got = [(r.qid, r.doc_id, round(r.confidence, 3), r["rank"]) for r in RT.law_lookup(q, laws).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "b", 1.0, 2), (4, "b", 1.0, 1), (4, "a", 0.75, 2)]
    scope = {r.qid: r for r in RT.law_scope(q, RT.law_lookup(q, laws, 5)).collect()}
    assert (scope[1].route, scope[1].allowed, scope[1].reason) == ("candidate_docs", ["a", "b"], "candidate_low_margin_or_tie")
    assert (scope[2].route, scope[2].reason, scope[3].reason) == ("loose", "no_match", "no_law_name")
    assert (scope[4].route, scope[4].allowed, scope[4].reason) == ("candidate_docs", ["b"], "candidate_multiple_docs|candidate_trim_top1")
    assert laws.filter(F.col("doc_id") == "a").count() == 1


def test_what_many_queries_refer_to_is_looked_up_once(spark, corpus, monkeypatch):
    """The lookup gets each reference once, and every query its first chunks in order."""
    chunks = corpus[1]
    asked = [(q, "Điều 5 Nghị định 12/2022/NĐ-CP quy định gì?") for q in range(20)] + [(20, "Điều 6 Nghị định 12/2022/NĐ-CP quy định gì?")]
    exact = spark.createDataFrame(asked, "qid int, query string").select("qid", R.legal_refs(F.col("query")).alias("refs"))
    seen, lookup = [], RT.structured_lookup
    monkeypatch.setattr(RT, "structured_lookup", lambda q, c: (seen.append(q.count()), lookup(q, c))[1])
    got = routed._structured(exact, chunks, 1).collect()
    assert seen == [2] and sorted((r.qid, r.id, r.match_type, r.rn) for r in got) == [(q, "n1", "article", 1) for q in range(20)] + [(20, "n3", "article", 1)]


def test_scoped_queries_find_what_plain_search_finds_in_their_scope(spark, corpus):
    """A posting meets the queries that may hit its document, each once, however often a scope names it."""
    ix, chunks = corpus[:2]
    q = spark.createDataFrame([(1, "bồi thường lao động"), (2, "bồi thường lao động"), (3, "đất")], "qid int, query string")
    scopes = {1: ["l1", "n1"], 2: ["b1", "n1", "s1"], 3: ["n1"]}
    allowed = spark.createDataFrame([(k, i) for k, v in scopes.items() for i in v * 2], "qid int, id string")
    every = {(r.qid, r.id): round(r.score, 9) for r in IX.search(ix, q, 50).collect()}
    got = IX.search(ix, q, 50, allowed=allowed).collect()
    assert {(r.qid, r.id): round(r.score, 9) for r in got} == {x: s for x, s in every.items() if x[1] in scopes[x[0]]} and got
