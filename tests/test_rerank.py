"""Rerank hits of whole texts, by hand and by SQL."""

import duckdb

from lexloom.plans import catalog, registry


def test_words_late_in_a_text_count(spark, tmp_path):
    head = "lorem ipsum_ " * 150  # 1,950 characters
    texts = {24: head + "quyen loi nguoi dung", 36: head + "dung x nguoi x loi x quyen", 48: "quyen " + head + "Nguoi_Dung", 60: head}
    spark.createDataFrame([(k, v, "vi", "src1", len(v)) for k, v in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(12, "quyen loi nguoi dung")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = {r.id: r.score for r in catalog.hits(spark, str(tmp_path), 20).collect()}
    found = {24: (4, 3), 36: (4, 0), 48: (3, 1)}  # words, and pairs of them side by side; item 12 names no document, article or clause
    want = {i: round(0.001 * score[i] + 0.0005 * w + 0.0015 * p, 7) for i, (w, p) in found.items()}
    got = catalog.heuristic_rerank(spark, str(tmp_path)).collect()
    assert {r.id: r.rerank_score for r in got} == want
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet/*.parquet')")
    assert sorted((r.qid, r.id, r.rerank_score, r.rank) for r in got) == sorted(con.sql(registry.ORACLES["heuristic_rerank"]).fetchall())
