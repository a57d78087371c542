"""Structured lookup: keys of chunks without a shuffle, and the same rows as from whole chunks."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.operators import legal as L
from lexloom.operators import routing as RT
from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"
WORDY = "3. " + ("w " * 700 + "\n\n") * 2
TEXTS = {
    "1": "Chương I. C\nĐiều 1. x\n1. a b\n1. again\n2. c\nĐiều 1. y\n1. third\nĐiều 2a\nno clause",
    "2": f"Điều 1. x\n{WORDY}\n{WORDY}{'v ' * 700}\n\nz\nĐiều 1. x\n3. short",
    "3": "\n".join(f"word{k}" * 2 for k in range(1500)), "4": "", "5": "Điều 1. x\n1. a\nNội dung " + "q" * 1100 + "\n2. b\n\n",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"t{k}", f"{k} /2024/nđ-CP", "", "", "", v) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id string, title string, document_number string, doc_type string, issuer string, issue_date string, content string")


def test_keys_are_those_of_the_chunks(docs):
    cols = ("chunk_id", "doc_id", "article", "clause")
    got = sorted(tuple(r) for r in L.chunk_keys(docs).select(*cols).collect())
    assert got == sorted(tuple(r) for r in L.chunks(docs).select(*cols).collect())
    ids = {r[0] for r in got}
    assert len(ids) == len(got) and {"1_d1_k1", "1_d1_k1_dup2", "1_d1_k1_dup3", "1_d2a", "2_d1_k3_s0", "2_d1_k3_s0_dup2", "2_d1_k3_s2", "2_d1_k3", "3_w0"} <= ids


def test_lookup_from_keys_and_from_chunks(spark, docs):
    asked = spark.createDataFrame([(1, "Khoản 1 Điều 1 Nghị định 1/2024/NĐ-CP"), (2, "Nghị định 1/2024/NĐ-CP"), (3, "Điều 1 văn bản 5/2024"), (4, "Điều 2a Nghị định 1/2024/NĐ-CP"), (5, "Luật Đất đai")], "qid long, query string")
    q = asked.select("qid", R.legal_refs(F.col("query")).alias("refs"))
    whole = sorted(tuple(r) for r in RT.structured_lookup(q, L.chunks(docs)).collect())
    assert sorted(tuple(r) for r in RT.structured_lookup(q, L.chunk_keys(docs), few=True).collect()) == whole
    assert (1, "1_d1_k1_dup2", "1", "clause") in whole and (3, "5_d1_k2", "5", "article") in whole and sum(r[0] == 2 for r in whole) == 5


def test_no_chunk_and_no_pair_is_shuffled(spark):
    plan = catalog.structured_lookup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_pieces_cover_texts_of_every_length(spark, tmp_path):
    texts = {1: "a" * 200, 2: "ế😀\n" * 134, 3: "", 4: None, 5: "b" * 401, 6: "c" * 400}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.pieces(spark, str(tmp_path)).collect()}
    cut = lambda x: [x] if not x else [x[k : k + 200] for k in range(0, len(x), 200)]
    assert got == {(i * 1_000_000 + k) * 5 + i % 5: p for i, x in texts.items() for k, p in enumerate([x] if i % 5 == 0 else cut(x))}
