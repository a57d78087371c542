"""Explicit schemas of the engine's tables, as DDL."""

METADATA = "id string, document_number string, title string, url string, legal_type string, legal_sectors string, issuing_authority string, issuance_date string, signers string"
CONTENT = "id string, content string"
DOCUMENT = "doc_id string, title string, document_number string, doc_type string, issuer string, issue_date string, legal_sectors array<string>, signers array<string>, url string, content string"
CRAWL = "url string, title string, content string, document_number string, source string, crawl_time string, meta struct<loai_van_ban:string,so_hieu:string,co_quan:string,nguoi_ky:string,ngay_ban_hanh:string,ngay_hieu_luc:string,tinh_trang:string,linh_vuc:string>"
CHUNK = "chunk_id string, doc_id string, title string, document_number string, doc_type string, issuer string, issue_date string, chapter string, section string, article string, clause string, point string, path string, text string, text_for_keyword string, token_count int"
EVAL_CASE = "case_id string, question string, expected_doc_id string, expected_article_ref string, expected_keywords array<string>, gold_answer string"
EVAL_RESULT = "run_id string, case_id string, trace_id string, hit_top5 int, hit_top10 int, rank_of_first_correct int, hit_expected_source int, hit_expected_article int, citation_correct int, grounded int, completeness_score int, hallucination int, retrieval_latency_ms int, answer_latency_ms int, total_latency_ms int, notes map<string,string>"
TRACE_RUN = "trace_id string, started_at timestamp, finished_at timestamp, status string, query string, route string, error string"
TRACE_EVENT = "event_id long, trace_id string, ts timestamp, stage string, payload string"
RETRIEVAL_HIT = "trace_id string, stage string, chunk_id string, rank int, score double, kept int, filter_reason string"
