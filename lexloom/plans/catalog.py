"""Registered queries on the driver's tables, each with the DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.functions import text as T
from lexloom.operators import corpus as C
from lexloom.operators import evaluate as E
from lexloom.operators import index as IX
from lexloom.operators import legal as L
from lexloom.operators import retrieval as V
from lexloom.operators import rewrite as Q
from lexloom.operators import routing as RT
from lexloom.operators import scoring as S
from lexloom.operators import search as SE
from lexloom.operators import trace as TR
from lexloom.plans.registry import query
from lexloom.sources import writers as W
from lexloom.sources.shared import kept, spread

WORDS = ("the", "and", "der", "que")
DUCK_WORD = "[0-9A-Za-zÀ-ỹĐđ]+"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on: over all cores even if it is one small file."""
    return spread(t(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


# --- scans, filters, statistics ---------------------------------------------------------------


@query("doc_min_length_filter", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(text) >= 50")
def doc_min_length_filter(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n")).filter(F.col("n") >= C.MIN_LENGTH)


@query("doc_keyword_filter", """SELECT doc_id FROM documents WHERE (lang IN ('en','fr') OR lang IS NULL) AND (regexp_matches(text, '(?i)the|and|der|que') OR regexp_matches(source, '(?i)src1') OR regexp_matches(lang, '(?i)fr'))""")
def doc_keyword_filter(spark, d):
    df = texts(spark, d)
    tests = C.domain_tests(F.col("lang"), F.col("text"), F.col("source"), F.col("lang"), types=["en", "fr"], sectors=list(WORDS), issuers=["src1"], titles=["fr"])
    return df.filter(C.domain_filter(tests)).select("doc_id")


@query("filter_stats", """WITH f AS (SELECT coalesce(lang, '') IN ('en','fr','') AS t, regexp_matches(text, '(?i)the|and|der|que') AS s, regexp_matches(source, '(?i)src1') AS i, regexp_matches(lang, '(?i)fr') AS ti FROM documents)
SELECT count(*) AS scanned, count(*) FILTER (NOT t) AS removed_by_type, count(*) FILTER (s) AS by_sector, count(*) FILTER (i) AS by_issuer, count(*) FILTER (ti) AS by_title, count(*) FILTER (t AND (s OR i OR ti)) AS kept FROM f""")
def filter_stats(spark, d):
    tests = C.domain_tests(F.col("lang"), F.col("text"), F.col("source"), F.col("lang"), types=["en", "fr"], sectors=list(WORDS), issuers=["src1"], titles=["fr"])
    return C.filter_stats(texts(spark, d), tests)


@query("crawl_filter", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src3') OR contains(lower(text), 'mentaire')")
def crawl_filter(spark, d):
    return t(spark, d, "documents").filter(C.crawl_filter(F.col("source"), F.col("text"), ["mentaire"], core=["src3"])).select("doc_id")


@query("freq_distribution", "SELECT coalesce(nullif(source, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def freq_distribution(spark, d):
    return C.frequencies(t(spark, d, "documents"), F.col("source"), 10)


@query("length_stats", "SELECT count(*) AS n, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS avg_length, CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length FROM documents")
def length_stats(spark, d):
    return C.length_stats(t(spark, d, "documents"), F.length("text").cast("long"))


@query("token_histogram", r"""WITH x AS (SELECT CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.5) AS INT) AS n FROM documents)
SELECT CASE WHEN n < 50 THEN '<50' WHEN n < 200 THEN '50-200' WHEN n < 500 THEN '200-500' WHEN n < 1024 THEN '500-1024' ELSE '>1024' END AS bucket, count(*) AS n FROM x GROUP BY 1""")
def token_histogram(spark, d):
    n = T.token_estimate(F.col("text"))
    return texts(spark, d).select(n.alias("k")).groupBy(C.token_bucket(F.col("k")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- text functions -----------------------------------------------------------------------------


@query("token_index", f"SELECT doc_id, array_to_string(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), ' ') AS tokens FROM documents")
def token_index(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(T.tokens(F.col("text"), normalise=True), " ").alias("tokens"))


@query("token_query", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')), ' ') AS tokens FROM benchmark")
def token_query(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text"), query=True, normalise=True), " ").alias("tokens"))


@query("accent_fold", "SELECT doc_id, translate(strip_accents(text), 'đĐ', 'dD') AS folded FROM documents")
def accent_fold(spark, d):
    return texts(spark, d).select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("ascii_normal", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS value FROM documents")
def ascii_normal(spark, d):
    return texts(spark, d).select("doc_id", T.ascii_normal(F.col("text")).alias("value"))


@query("whitespace_clean", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS value FROM documents""")
def whitespace_clean(spark, d):
    return texts(spark, d).select("doc_id", T.clean_text_native(F.col("text")).alias("value"))


@query("clean_text")
def clean_text(spark, d):
    return texts(spark, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("value"))


@query("token_estimate", r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.5) AS INT) AS n FROM documents")
def token_estimate(spark, d):
    return texts(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("n"))


@query("text_digest", "SELECT doc_id, substr(sha1(text), 1, 16) AS digest FROM documents")
def text_digest(spark, d):
    return t(spark, d, "documents").select("doc_id", T.text_digest(F.col("text")).alias("digest"))


@query("query_phrases", f"""WITH q AS (SELECT item_id, list_filter(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')) AS ts FROM benchmark),
p AS (SELECT item_id, unnest(ts) AS phrase FROM q UNION SELECT item_id, ts[i] || ' ' || ts[i + 1] FROM (SELECT item_id, ts, unnest(range(1, len(ts))) AS i FROM q))
SELECT DISTINCT item_id, phrase FROM p WHERE length(phrase) >= 6""")
def query_phrases(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.explode(T.phrases(F.col("text"), 6)).alias("phrase"))


@query("focus_terms", r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[a-z0-9]+'), 1) AS i FROM benchmark),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w NOT IN ('the','and','of') AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM f)
SELECT item_id, string_agg(w, ' ' ORDER BY rn) AS terms FROM r WHERE rn <= 3 GROUP BY 1""")
def focus_terms(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(T.focus_terms(F.col("text"), ["the", "and", "of"]), " ").alias("terms")).filter("terms <> ''")


@query("completeness", "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 1 WHEN length(trim(text)) < 120 THEN 2 WHEN length(trim(text)) < 300 THEN 3 WHEN length(trim(text)) < 700 THEN 4 ELSE 5 END AS score FROM documents")
def completeness(spark, d):
    return t(spark, d, "documents").select("doc_id", T.completeness(F.col("text")).alias("score"))


@query("json_props", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def json_props(spark, d):
    return t(spark, d, "events").select("event_type", T.json_object(F.col("props"), "k string")["k"].alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"))


@query("mojibake")
def mojibake(spark, d):
    return texts(spark, d).select("doc_id", T.mend_mojibake(F.col("text")).alias("text"))


@query("parse_list", "SELECT event_id, string_split(replace(event_type || ',' || user_id, ' ', ''), ',') AS items FROM events")
def parse_list(spark, d):
    return t(spark, d, "events").select("event_id", T.parse_list(F.concat_ws(", ", "event_type", F.col("user_id").cast("string"))).alias("items"))


# --- joins --------------------------------------------------------------------------------------


@query("left_join_meta", "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)")
def left_join_meta(spark, d):
    meta = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    return t(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("id")).join(meta, "id", "left").select("doc_id", "source", "quality")


@query("inner_join_content", "SELECT CAST(d.doc_id AS VARCHAR) AS id, l.quality, length(d.text) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE length(d.text) >= 50")
def inner_join_content(spark, d):
    content = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    meta = t(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return C.join_filtered(content, meta).select("id", "quality", F.length("content").cast("long").alias("n"))


@query("semi_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_scope(spark, d):
    allowed = t(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(allowed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("anti_incremental", "SELECT DISTINCT o_orderkey AS chunk_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def anti_incremental(spark, d):
    known = t(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("chunk_id"))
    return V.index_append(known, t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id")))


@query("index_append", """SELECT count(*) AS n, CAST(sum(len(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '[0-9A-Za-zÀ-ỹĐđ]+'))) AS BIGINT) AS tokens FROM documents""")
def index_append(spark, d):
    """A third of the documents builds the index, all of them are appended to it, twice: each counts once."""
    docs = texts(spark, d).select("doc_id", "text")

    def grow(path):
        IX.build(docs.filter("doc_id % 3 = 0"), path)
        IX.append(docs, path)
        IX.append(docs, path)

    ix = IX.read(spark, kept(spark, "bm25-grown", f"{d}/documents.parquet", grow))
    per = ix.postings.agg(F.sum("tf").alias("tokens"))
    return IX.count(ix).crossJoin(F.broadcast(per))  # one row each


@query("bm25_multifield", f"""WITH x AS (SELECT doc_id, unnest([{{'field': 'content', 'ts': regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}')}}, {{'field': 'title', 'ts': regexp_extract_all(lower(replace(nfc_normalize(substr(text, 1, 60)), '_', ' ')), '{DUCK_WORD}')}}]) AS x FROM documents),
dt AS (SELECT doc_id, x.field AS field, x.ts AS ts FROM x), st AS (SELECT field, count(*) AS n, avg(len(ts)) AS al FROM dt GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))) AS term FROM benchmark),
po AS (SELECT doc_id, field, len(ts) AS dl, unnest(ts) AS term FROM dt), tf AS (SELECT term, field, doc_id, any_value(dl) AS dl, count(*) AS tf FROM po WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, field, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT qid, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term, field) JOIN st USING (field) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM sc) SELECT qid, doc_id AS id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank < 10""")
def bm25_multifield(spark, d):
    """Terms in the text or in its head, which stands for a title."""
    docs = texts(spark, d).select("doc_id", "text", F.substring("text", 1, 60).alias("title"))
    ix = IX.read(spark, kept(spark, "bm25-fields", f"{d}/documents.parquet", lambda path: IX.build(docs, path, fields={"content": "text", "title": "title"})))
    return IX.search(ix, passages(spark, d), 10).select("qid", "id", F.round("score", 4).alias("score"), "rank")


@query("bm25_debug", f"""WITH q AS (SELECT item_id AS qid, list_distinct(list_filter(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))) AS ts FROM benchmark),
m AS (SELECT qid, count(DISTINCT doc_id) AS n FROM (SELECT qid, unnest(ts) AS term FROM q) JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}')) AS term FROM documents) USING (term) GROUP BY 1)
SELECT qid, CAST(len(ts) AS INT) AS n_tokens, ['content'] AS fields, false AS wildcard, false AS fuzzy, least(coalesce(n, 0), 80) AS hits FROM q LEFT JOIN m USING (qid)""")
def bm25_debug(spark, d):
    ix = index_of(spark, d)
    found = IX.search_debug(ix, passages(spark, d), hits(spark, d, 80))
    return found.select("qid", F.size("tokens").alias("n_tokens"), "fields", "wildcard", "fuzzy", "hits")


@query("missing_pages", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_pages(spark, d):
    return C.missing_pages(t(spark, d, "part").select("p_partkey"), t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# --- retrieval ----------------------------------------------------------------------------------

BM25_SQL = f"""WITH dt AS (SELECT doc_id, regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM dt),
qt AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))) AS term FROM benchmark),
po AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM dt), tf AS (SELECT term, doc_id, any_value(dl) AS dl, count(*) AS tf FROM po WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT qid, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM sc)"""


def index_of(spark, d):
    """The stored index of the documents' texts, built once in an application."""
    return IX.read(spark, kept(spark, "bm25", f"{d}/documents.parquet", lambda path: IX.build(texts(spark, d).select("doc_id", "text"), path)))


def passages(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def hits(spark, d, k=10, allowed=None):
    return IX.search(index_of(spark, d), passages(spark, d), k, allowed=allowed)


@query("bm25_topk", BM25_SQL + " SELECT qid, doc_id AS id, round(score, 4) AS score, CAST(rank AS INT) AS rank, d.source, d.lang FROM rk JOIN documents d USING (doc_id) WHERE rank < 10")
def bm25_topk(spark, d):
    return V.hydrate(hits(spark, d), t(spark, d, "documents"), "doc_id", "source", "lang").select("qid", "id", F.round("score", 4).alias("score"), "rank", "source", "lang")


@query("bm25_terms", f"""WITH po AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(nfc_normalize(text), '_', ' ')), '{DUCK_WORD}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM po GROUP BY 1""")
def bm25_terms(spark, d):
    return IX.postings_of(texts(spark, d), "doc_id", {"content": "text"}).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("bm25_scoped", BM25_SQL + ", s2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS r2 FROM rk WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT qid, doc_id AS id, round(score, 4) AS score, CAST(r2 AS INT) AS rank FROM s2 WHERE r2 < 5")
def bm25_scoped(spark, d):
    allowed = t(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return hits(spark, d, 5, allowed).select("qid", "id", F.round("score", 4).alias("score"), "rank")


VEC_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
sc AS (SELECT q.vec_id AS qid, b.vec_id AS id, list_dot_product(q.e, b.e) / (q.n * b.n) AS score FROM u q, u b WHERE q.vec_id % 50 = 0),
rv AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sc)"""


def vector_hits(spark, d, k=10):
    e = t(spark, d, "embeddings")
    return V.vector_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), k)


@query("vector_topk", VEC_SQL + " SELECT qid, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM rv WHERE rank < 10")
def vector_topk(spark, d):
    return vector_hits(spark, d).select("qid", "id", F.round("score", 4).alias("score"), "rank")


RRF_SQL = BM25_SQL + ", " + VEC_SQL.removeprefix("WITH ").replace("sc AS", "sv AS").replace("FROM sc)", "FROM sv)")
FUSED_SQL = RRF_SQL + """, al AS (SELECT qid, doc_id AS id, rank, 0 AS source FROM rk WHERE rank < 10 UNION ALL SELECT qid, id, rank, 1 FROM rv WHERE rank < 10),
fu AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(source * 1000 + rank) AS seen FROM al GROUP BY ALL), rf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen, id) - 1 AS rank FROM fu)"""


@query("rrf_fusion", FUSED_SQL + " SELECT qid, id, round(score, 8) AS score, CAST(rank AS INT) AS rank FROM rf")
def rrf_fusion(spark, d):
    return V.rrf(hits(spark, d), vector_hits(spark, d)).select("qid", "id", F.round("score", 8).alias("score"), "rank")


@query("merge_by_chunk", RRF_SQL + """, al AS (SELECT qid, doc_id AS id, score, rank, 0 AS source FROM rk WHERE rank < 10 UNION ALL SELECT qid, id, score, rank, 1 FROM rv WHERE rank < 10),
fu AS (SELECT qid, id, max(score) AS score, min(source * 1000 + rank) AS seen FROM al GROUP BY ALL), rf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seen, id) - 1 AS rank FROM fu) SELECT qid, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM rf WHERE rank < 12""")
def merge_by_chunk(spark, d):
    return V.merge_hits(hits(spark, d), vector_hits(spark, d), limit=12).select("qid", "id", F.round("score", 4).alias("score"), "rank")


@query("margin_top2", BM25_SQL + """, two AS (SELECT qid, max(CASE WHEN rank = 0 THEN round(score, 9) END) AS a, coalesce(max(CASE WHEN rank = 1 THEN round(score, 9) END), 0) AS b FROM rk GROUP BY 1)
SELECT qid, round(a, 4) AS top1, round(b, 4) AS top2, round(a - b, 4) + 0.0 AS margin, CASE WHEN a >= round(1.3 * b, 9) THEN 2 ELSE 3 END AS keep FROM two""")
def margin_top2(spark, d):
    return V.margins(hits(spark, d)).select("qid", F.round("top1", 4).alias("top1"), F.round("top2", 4).alias("top2"), F.round("margin", 4).alias("margin"), "keep")


@query("topk_cutoff", BM25_SQL + " SELECT qid, doc_id AS id, CAST(rank AS INT) AS rank, 'top_k_cutoff' AS reason FROM rk WHERE rank >= 5 AND rank < 10")
def topk_cutoff(spark, d):
    return V.cutoff(hits(spark, d), 5)[1].select("qid", "id", "rank", "reason")


UNITS_SQL = """WITH h AS (SELECT 0 AS qid, l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS article, '' AS clause, l_linestatus AS text, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rank FROM lineitem),
k AS (SELECT *, CASE WHEN article <> '' OR clause <> '' THEN doc_id || '|a:' || article || '|c:' || clause ELSE doc_id || '|h:' || substr(sha1(text), 1, 16) END AS unit_key FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY rank) AS rn, first_value(id) OVER (PARTITION BY unit_key ORDER BY rank) AS kept_id FROM k)"""


def unit_hits(spark, d):
    li = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").cast("string").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("article"), F.lit("").alias("clause"), F.col("l_linestatus").alias("text"))
    return li.withColumn("qid", F.lit(0)).withColumn("rank", F.col("id"))


@query("legal_unit_dedup", UNITS_SQL + " SELECT id, unit_key FROM r WHERE rn = 1")
def legal_unit_dedup(spark, d):
    return V.dedup_units(unit_hits(spark, d))[0].select("id", "unit_key")


@query("dedup_rejects", UNITS_SQL + " SELECT id, unit_key, kept_id, 'duplicate_legal_unit' AS reason FROM r WHERE rn > 1")
def dedup_rejects(spark, d):
    return V.dedup_units(unit_hits(spark, d))[1].select("id", "unit_key", "kept_id", "reason")


@query("merge_prefer_known", """WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS document_number, CASE WHEN event_id % 3 = 0 THEN 'Chưa rõ' WHEN event_id % 3 = 1 THEN event_type END AS status FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY document_number ORDER BY CASE WHEN status = 'Chưa rõ' THEN 1 ELSE 0 END, event_id) AS n FROM r) SELECT document_number, event_id, status FROM k WHERE n = 1""")
def merge_prefer_known(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("document_number"), F.lit("").alias("url"), F.when(F.col("event_id") % 3 == 0, C.UNKNOWN_STATUS).when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("status"))
    return C.merge_known(e, "event_id")[0].select("document_number", "event_id", "status")


# --- chunking ---------------------------------------------------------------------------------------


@query("sliding_window_chunks", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents), n AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 682 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 682) / 640.0) AS INT) END AS c FROM w),
x AS (SELECT doc_id, ws, unnest(range(0, c)) AS i FROM n) SELECT doc_id, CAST(i AS INT) AS i, array_to_string(ws[i * 640 + 1 : i * 640 + 682], ' ') AS body FROM x""")
def sliding_window_chunks(spark, d):
    return L.window_rows(texts(spark, d), "text", "doc_id").select("doc_id", "i", "body")


@query("paragraph_pack")
def paragraph_pack(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(L.pack_paragraphs(F.regexp_replace("text", "\n", "\n\n"), 200)).alias("i", "body"))


LAWS = [
    ("1", "Luật Đất đai 2024", "31/2024/QH15", "Luật", "QUỐC HỘI", "2024-01-18", "Chương I. QUY ĐỊNH CHUNG\nMục 1. Phạm vi\nĐiều 1. Phạm vi điều chỉnh.\nLời dẫn.\n1. Khoản thứ nhất.\na) Điểm a\nđ) Điểm đ\n2. Khoản thứ hai.\nChương II\nĐiều 2a\nTiêu đề ở dòng sau\nNội dung không có khoản.\nNơi nhận:"),
    ("2", "Nghị định quy định xử phạt vi phạm hành chính trong lĩnh vực lao động và bảo hiểm xã hội năm 2022", "12/2022/NĐ-CP", "Nghị định", "CHÍNH PHỦ", "2022-01-17", "Nơi nhận:\n" + "Không có điều nào. " * 20),
    ("3", "Quyết định của UBND tỉnh", "80/2025/QĐ-UBND", "Quyết định", "UBND", "2025-03-01", "Điều 1. Một\n1. a.\nĐiều 1. Một\n1. a."),
    ("4", "Văn bản hợp nhất Bộ luật Lao động 2019", "", "Văn bản hợp nhất", "", "", ""),
]
LAW_COLUMNS = "doc_id string, title string, document_number string, doc_type string, issuer string, issue_date string, content string"


def laws(spark):
    return spark.createDataFrame(LAWS, LAW_COLUMNS)


# --- queries, routes, rewriting ------------------------------------------------------------------------

QUESTIONS = [
    (1, "Điều 5 Nghị định 12/2022/NĐ-CP quy định gì?", "structured_exact"), (2, "Nội dung 80/2025/QĐ-UBND", "narrow_bm25"), (3, "Luật Đất đai", "narrow_bm25"),
    (4, "Luật Đất đai quy định thế nào về bồi thường khi thu hồi đất", "law_anchored_hybrid"), (5, "thẩm quyền xử phạt vi phạm hành chính của công chức như thế nào", "hybrid_default"), (6, "", "hybrid_default"), (7, "aaaa lap quan kinh", "hybrid_default"),
]


def questions(spark):
    return spark.createDataFrame([x[:2] for x in QUESTIONS], "qid int, query string")


# --- evaluation -----------------------------------------------------------------------------------------

RESULT_SQL = "(SELECT CASE WHEN quality = 1 THEN 1 ELSE 0 END AS hit_top5, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS hit_top10, toxic AS hit_expected_source, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 END AS rank, quality AS citation_correct, 1 - toxic AS grounded, toxic AS hallucination, doc_id AS ms, doc_id % 4 AS route FROM labels)"


def results(spark, d):
    return t(spark, d, "labels").select(
        F.col("quality").alias("hit_top5"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("hit_top10"), F.col("toxic").alias("hit_expected_source"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5).alias("rank_of_first_correct"),
        F.col("quality").alias("citation_correct"), (1 - F.col("toxic")).alias("grounded"), F.col("toxic").alias("hallucination"), F.col("doc_id").alias("total_latency_ms"), F.element_at(F.array(*map(F.lit, E.ROUTES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("actual_route"),
    )


@query("eval_summary", f"""SELECT count(*) AS total_cases, round(count(*) FILTER (coalesce(nullif(hit_top5, 0), hit_expected_source, 0) = 1) / count(*), 4) AS recall_at_5, round(count(*) FILTER (coalesce(nullif(hit_top10, 0), hit_expected_source, 0) = 1) / count(*), 4) AS recall_at_10,
round(sum(CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END) / count(*), 4) AS mrr, round(count(*) FILTER (citation_correct = 1) / count(*), 4) AS citation_accuracy, round(count(*) FILTER (grounded = 1) / count(*), 4) AS grounded_rate, round(count(*) FILTER (hallucination = 1) / count(*), 4) AS hallucination_rate,
CAST(floor(avg(ms)) AS BIGINT) AS latency_avg, CAST(floor(quantile_cont(ms, 0.5)) AS BIGINT) AS latency_p50, CAST(floor(quantile_cont(ms, 0.95)) AS BIGINT) AS latency_p95 FROM {RESULT_SQL}""")
def eval_summary(spark, d):
    return E.eval_summary(results(spark, d))


@query("latency_percentiles", "SELECT event_type, CAST(round_even(avg(value), 0) AS BIGINT) AS avg_ms, CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95, CAST(round_even(quantile_cont(value, 0.99), 0) AS BIGINT) AS p99, CAST(trunc(max(value)) AS BIGINT) AS max_ms FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return E.latency_stats(t(spark, d, "events"), "value", "event_type")


@query("route_summary", f"""SELECT ['structured_exact','narrow_bm25','law_anchored_hybrid','hybrid_default'][route + 1] AS actual_route, count(*) AS cases, round(avg(grounded), 4) AS grounded, round(avg(hallucination), 4) AS hallucination, CAST(round_even(quantile_cont(ms, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(ms, 0.95), 0) AS BIGINT) AS p95 FROM {RESULT_SQL} GROUP BY 1""")
def route_summary(spark, d):
    return E.route_summary(results(spark, d), E.ROUTES, ["grounded", "hallucination"], "total_latency_ms")


@query("label_distribution", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN value > 50 THEN 'HIGH' END AS label FROM events UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'EVEN' END FROM events UNION ALL SELECT CASE WHEN event_type = 'click' THEN 'CLICK' END FROM events) WHERE label IS NOT NULL GROUP BY 1")
def label_distribution(spark, d):
    found, _ = E.labels({"HIGH": F.col("value") > 50, "EVEN": F.col("user_id") % 2 == 0, "CLICK": F.col("event_type") == "click"})
    return E.label_distribution(t(spark, d, "events").select(found.alias("labels")))


@query("metric_delta", "WITH a AS (SELECT event_type AS metric, round(avg(value), 4) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 4) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) SELECT metric, a.v AS now, b.v AS before, round(coalesce(a.v, 0) - coalesce(b.v, 0), 4) AS delta FROM a FULL JOIN b USING (metric)")
def metric_delta(spark, d):
    e = t(spark, d, "events")
    parts = [e.filter(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value")) for k in (0, 1)]
    return E.metric_delta(*parts)


@query("recall_mrr", BM25_SQL + """, m AS (SELECT rk.qid, rk.rank, l.quality = 1 AS ok FROM rk JOIN labels l USING (doc_id) WHERE rk.rank < 10) SELECT qid, CAST(min(CASE WHEN ok THEN rank END) + 1 AS INT) AS rank_of_first_correct, max(CASE WHEN rank < 5 AND ok THEN 1 ELSE 0 END) AS hit_top5, max(CASE WHEN rank < 10 AND ok THEN 1 ELSE 0 END) AS hit_top10 FROM m GROUP BY 1""")
def recall_mrr(spark, d):
    m = hits(spark, d).join(t(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok")), "id")
    return E.first_ranks(m, "qid")


@query("ablation", "SELECT item_id, v AS variant FROM benchmark, (VALUES ('A'), ('B'), ('C'), ('D')) AS t(v)")
def ablation(spark, d):
    sw = {"A": (True, True, True), "B": (False, True, True), "C": (True, False, True), "D": (True, True, False)}
    return E.ablation(t(spark, d, "benchmark").select("item_id"), sw).select("item_id", "variant")


@query("interleave", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn FROM events")
def interleave(spark, d):
    return C.interleave(t(spark, d, "events"), "event_type", "event_id").select("event_id", F.col("turn").cast("long").alias("turn"))


@query("route_counts", "SELECT event_type AS route, count(*) AS n, count(*) >= 20 AS enough FROM events GROUP BY 1")
def route_counts(spark, d):
    return E.route_counts(t(spark, d, "events").withColumn("route", F.col("event_type")), {x: 20 for x in ("click", "view", "purchase", "search", "login", "error", "signup", "logout")})


# --- traces, sessions, pages ------------------------------------------------------------------------------


@query("trace_upsert", "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(n.w, o.w) AS w FROM (SELECT user_id AS k, max(value) AS v, max(event_id) AS w FROM events WHERE event_type = 'click' GROUP BY 1) o FULL JOIN (SELECT user_id AS k, min(value) AS v, CASE WHEN user_id % 2 = 0 THEN min(event_id) END AS w FROM events WHERE event_type <> 'click' GROUP BY 1) n ON o.k = n.k")
def trace_upsert(spark, d):
    e = t(spark, d, "events")
    old = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("v"), F.max("event_id").alias("w"))
    new = e.filter("event_type <> 'click'").groupBy(F.col("user_id").alias("k")).agg(F.min("value").alias("v"), F.min("event_id").alias("w0")).select("k", "v", F.when(F.col("k") % 2 == 0, F.col("w0")).alias("w"))
    return TR.upsert(old, new, "k", keep_old=("w",))


@query("recent_traces", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_traces(spark, d):
    return TR.recent(t(spark, d, "events"), 50, "ts", "event_id").select("event_id", "event_type")


@query("trace_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def trace_latest(spark, d):
    return TR.latest(t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("session_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def session_history(spark, d):
    return TR.history(t(spark, d, "conversations"), 5).select("conv_id", "turn", "role")


@query("session_turns", "SELECT conv_id, CAST(floor(count(*) / 2) AS BIGINT) AS turns FROM conversations GROUP BY 1")
def session_turns(spark, d):
    return TR.turn_counts(t(spark, d, "conversations"))


@query("url_normalize", "SELECT page_id, regexp_replace(regexp_replace(trim(url), '[#?].*$', ''), '/+$', '') AS url FROM pages")
def url_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


@query("missing_urls", "SELECT coalesce(nullif(split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/', 2), ''), '') AS category, count(*) AS n, count(*) FILTER (ends_with(url, '.aspx')) AS aspx, count(*) FILTER (length(url) < 80) AS short FROM pages GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def missing_urls(spark, d):
    x = C.url_tests(F.col("url"))
    return t(spark, d, "pages").groupBy(x["category"].alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(x["ends_aspx"]).alias("aspx"), F.count_if(x["short"]).alias("short")).orderBy(F.desc("n"), "category").limit(20)


@query("page_fields")
def page_fields(spark, d):
    return C.page_fields(texts(spark, d, "pages"))


@query("event_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- scoring ------------------------------------------------------------------------------------------------

#: BM25 over three passes of each passage: the whole of it, its head and its tail.
PASS_SQL = (
    BM25_SQL.replace("WITH dt AS", "WITH ps AS (SELECT item_id * 10 AS qid, text FROM benchmark UNION ALL SELECT item_id * 10 + 1, substr(text, 1, 60) FROM benchmark UNION ALL SELECT item_id * 10 + 2, right(text, 60) FROM benchmark), dt AS", 1)
    .replace("SELECT DISTINCT item_id AS qid,", "SELECT DISTINCT qid,").replace("AS term FROM benchmark)", "AS term FROM ps)")
)
PASSES_SQL = PASS_SQL + """, p AS (SELECT qid // 10 AS qid, doc_id, ['core', 'expanded', 'title'][qid % 10 + 1] AS pass, rank + 1 AS rank FROM rk WHERE rank < CASE WHEN qid % 10 = 2 THEN 12 ELSE 20 END),
c AS (SELECT qid, doc_id, coalesce(1.0::DOUBLE / (60 + min(CASE WHEN pass = 'core' THEN rank END)), 0) + 0.85::DOUBLE * coalesce(1.0::DOUBLE / (60 + min(CASE WHEN pass = 'expanded' THEN rank END)), 0) + 1.10::DOUBLE * coalesce(1.0::DOUBLE / (60 + min(CASE WHEN pass = 'title' THEN rank END)), 0) + 0.8 * (0.62 * (doc_id % 5) / 4 + 0.38 * (doc_id % 3) / 2) + 0.18 * 0.5 + 0.2 * (doc_id % 2) + 0.28 * (doc_id % 4) / 4 + 0.55 * 0.3 AS score, count(DISTINCT pass) AS sources FROM p GROUP BY qid, doc_id)"""


def passes(spark, d):
    """Hits of three recall passes, searched at once, with components that follow from the id."""
    q = passages(spark, d)
    parts = {"core": F.col("query"), "expanded": F.substring("query", 1, 60), "title": F.right(F.col("query"), F.lit(60))}
    rows = q.select("qid", F.explode(F.array(*(F.struct(F.lit(n).alias("pass"), c.alias("query")) for n, c in parts.items()))).alias("p")).select("qid", "p.*")
    i = F.col("doc_id")
    return SE.pass_hits(index_of(spark, d), rows).select("qid", "pass", F.col("id").alias("doc_id"), (F.col("rank") + 1).alias("rank")).withColumns({
        "family": F.concat(F.lit("luat so "), (i % 7).cast("string")), "role": F.when(i % 2 == 0, "law_core").otherwise("implementation"), "concept": (i % 5) / 4, "actor_action": (i % 3) / 2, "type_prior": F.lit(0.5),
        "role_prior": (i % 2).cast("double"), "title_anchor": (i % 4) / 4, "identity": F.lit(0.3), "wrong_role": F.lit(0.0), "genericity": F.lit(0.0),
    })


@query("candidate_docs", PASSES_SQL + " SELECT qid, doc_id, round(score, 6) AS score, sources FROM c")
def candidate_docs(spark, d):
    return S.candidate_documents(passes(spark, d)).select("qid", "doc_id", F.round("score", 6).alias("score"), "sources")


@query("family_resolution")
def family_resolution(spark, d):
    return S.families(S.candidate_documents(passes(spark, d)))


@query("focus_targets", BM25_SQL + ", f AS (SELECT qid, source, count(*) AS n, min(rank) AS first_rank FROM rk JOIN documents USING (doc_id) WHERE rank < 12 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_rank, source) AS rn FROM f WHERE n >= 2 AND first_rank <= 2) SELECT qid, source, n, CAST(first_rank AS INT) AS first_rank FROM r WHERE rn <= 2")
def focus_targets(spark, d):
    h = hits(spark, d, 12).join(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return S.focus_targets(h, "source")


@query("hybrid_search", FUSED_SQL + " SELECT qid, id, round(score, 8) AS score, CAST(rank AS INT) AS rank, substr(d.text, 1, 1200) AS text FROM rf JOIN documents d ON d.doc_id = rf.id WHERE rank < 10")
def hybrid_search(spark, d):
    fused = V.rrf(hits(spark, d), vector_hits(spark, d))
    final, _ = V.cutoff(fused, 10)
    return V.hydrate(final, t(spark, d, "documents").withColumn("text", F.substring("text", 1, 1200)), "doc_id", "text").select("qid", "id", F.round("score", 8).alias("score"), "rank", "text")


# --- search stages: documents stand for chunks, their numbers, articles and clauses follow from the id --------------


def units(spark, d):
    i = F.col("doc_id")
    number = F.concat((i % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP"))
    part = lambda k: F.when(i % k > 0, (i % k).cast("string")).otherwise("")
    df = t(spark, d, "documents").select(i.alias("id"), i.cast("string").alias("doc_id"), F.concat(F.lit("Luật "), "source", F.lit(" 2020")).alias("title"), part(6).alias("article"), part(4).alias("clause"), number.alias("document_number"), F.col("text"), F.concat(F.lit("luat "), "source").alias("family"))
    return df.withColumn("path", L.breadcrumb(F.col("title"), F.lit(""), F.lit(""), F.col("article"), F.col("clause")))


def asked(spark, d):
    """Passages that name a decree (two of three), an article and a clause."""
    q = F.col("qid")
    decree = F.when(q % 3 > 0, F.concat(F.lit(" Nghị định "), (q % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP"))).otherwise("")
    named = F.concat(F.lit("Khoản "), (q % 4).cast("string"), F.lit(" Điều "), (q % 6).cast("string"), decree)
    return passages(spark, d).select("qid", "query", R.legal_refs(named).alias("refs"))


def unit_rows(spark, d, k=10):
    return hits(spark, d, k).join(units(spark, d), "id").join(asked(spark, d).select("qid", "refs"), "qid").withColumns({
        "in_document": SE.document_anchor(F.col("refs"), F.col("doc_id"), F.col("title"), F.col("path"), F.col("document_number")), "in_unit": SE.unit_anchor(F.col("refs"), F.col("article"), F.col("clause"), F.col("path")),
    })


ANCHOR_SQL = BM25_SQL + """, an AS (SELECT *, qid % 3 > 0 AND qid % 9 = doc_id % 9 AS in_document, coalesce(qid % 6 = doc_id % 6, false) AND qid % 4 = doc_id % 4 AS in_unit FROM rk WHERE rank < 10)"""


@query("hit_anchors", ANCHOR_SQL + " SELECT qid, doc_id AS id, in_document, in_unit AND qid % 6 > 0 AND qid % 4 > 0 AS in_unit FROM an WHERE qid % 6 > 0 AND qid % 4 > 0")
def hit_anchors(spark, d):
    return unit_rows(spark, d).filter("qid % 6 > 0 AND qid % 4 > 0").select("qid", "id", "in_document", "in_unit")


@query("skip_vector", BM25_SQL + """, an AS (SELECT qid, rank, qid % 3 > 0 AND qid % 9 = doc_id % 9 AS a, CASE WHEN qid % 6 = 0 THEN doc_id % 6 = 0 AND false ELSE qid % 6 = doc_id % 6 END AND CASE WHEN qid % 4 = 0 THEN false ELSE qid % 4 = doc_id % 4 END AS u FROM rk WHERE rank < 3)
SELECT item_id AS qid, coalesce((item_id % 3 > 0) AND bool_or(rank = 0 AND a) AND bool_or(a AND u), false) AS skip FROM benchmark LEFT JOIN an ON item_id = qid GROUP BY item_id""")
def skip_vector(spark, d):
    q = asked(spark, d).select("qid", SE.has_document(F.col("refs")).alias("has_document"))
    return SE.skip_vector(q, unit_rows(spark, d))


@query("compact_hits", BM25_SQL + """ SELECT qid, doc_id AS chunk_id, round(score, 4) AS score, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 6 > 0 AND doc_id % 4 > 0 THEN (doc_id % 6) || ' - ' || (doc_id % 4) WHEN doc_id % 6 > 0 THEN CAST(doc_id % 6 AS VARCHAR) WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS VARCHAR) END AS article_ref FROM rk WHERE rank < 10""")
def compact_hits(spark, d):
    return SE.compact_hits(hits(spark, d, 20).join(units(spark, d), "id")).withColumn("score", F.round("score", 4))


SHORT_SQL = BM25_SQL + """, h AS (SELECT qid, doc_id, rank, source FROM rk JOIN documents USING (doc_id) WHERE rank < 20), se AS (SELECT *, doc_id % 7 = qid % 7 OR (qid % 2 = 0 AND source = 'src1') AS i FROM h),
an AS (SELECT *, bool_or(i) OVER (PARTITION BY qid) AS a FROM se), sh AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS r2 FROM an WHERE i OR NOT a)"""


@query("shortlist", SHORT_SQL + " SELECT qid, doc_id AS id, CAST(r2 AS INT) AS rank FROM sh WHERE r2 < 8")
def shortlist(spark, d):
    h = hits(spark, d, 20).join(units(spark, d), "id")
    mine = h.filter(F.col("id") % 7 == F.col("qid") % 7).groupBy("qid").agg(F.collect_set("doc_id").alias("docs"))
    selected = passages(spark, d).select("qid").join(mine, "qid", "left").withColumn("families", F.when(F.col("qid") % 2 == 0, F.array(F.lit("luat src1"))).otherwise(F.array().cast("array<string>")))
    return SE.shortlist(h, selected, 8).select("qid", "id", "rank")


@query("scope_meet", """WITH x AS (SELECT doc_id, [doc_id % 4, doc_id % 6 + 1] AS s, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [doc_id % 3, doc_id % 5] END AS a FROM documents)
SELECT doc_id, CAST(list_sum(CASE WHEN len(a) = 0 THEN list_distinct(s) WHEN len(list_intersect(s, a)) > 0 THEN list_intersect(s, a) ELSE list_distinct(a) END) AS BIGINT) AS total FROM x""")
def scope_meet(spark, d):
    i = F.col("doc_id")
    a = F.when(i % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 3, i % 5))
    return t(spark, d, "documents").select("doc_id", F.aggregate(F.array_distinct(SE.scope_meet(F.array(i % 4, i % 6 + 1), a)), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("early_exit", BM25_SQL + """, al AS (SELECT item_id AS qid, (SELECT list(CAST(doc_id AS VARCHAR)) FROM rk WHERE rk.qid = item_id AND rank < (item_id % 5)) AS allowed, (item_id % 4) * 0.3 AS confidence, (item_id % 3) * 0.02 AS margin FROM benchmark),
h AS (SELECT qid, count(*) AS n, max(CASE WHEN rank < 4 AND NOT list_contains(allowed, CAST(doc_id AS VARCHAR)) THEN 1 ELSE 0 END) AS outside, round(max(CASE WHEN rank = 0 THEN score END) - coalesce(max(CASE WHEN rank = 1 THEN score END), 0), 9) AS lead, least(count(*), 4) AS docs FROM rk JOIN al USING (qid) WHERE rank < 10 GROUP BY 1),
r AS (SELECT qid, lead, CASE WHEN n IS NULL THEN 'no_bm25_hits' WHEN coalesce(len(allowed), 0) = 0 THEN 'no_allowed_doc_ids' WHEN n < 2 THEN 'insufficient_bm25_hits' WHEN outside = 1 THEN 'top_rows_outside_scope' WHEN len(allowed) = 1 AND lead >= -0.01 THEN 'single_doc_scope' WHEN len(allowed) <= 2 AND docs <= 1 AND lead >= -0.02 THEN 'small_scope_consistent_doc' WHEN confidence >= 0.86 AND (margin >= 0.02 OR docs <= 1) AND lead >= 0.015 THEN 'scoped_bm25_strong_lead' ELSE 'no_strong_lead' END AS reason FROM al LEFT JOIN h USING (qid))
SELECT qid, reason, reason IN ('single_doc_scope', 'small_scope_consistent_doc', 'scoped_bm25_strong_lead') AS exit, round(CASE WHEN reason IN ('single_doc_scope', 'small_scope_consistent_doc', 'scoped_bm25_strong_lead', 'no_strong_lead') THEN lead ELSE 0 END, 4) + 0.0 AS score_gap FROM r""")
def early_exit(spark, d):
    h = hits(spark, d).withColumn("doc_id", F.col("id").cast("string"))
    scope = h.filter(F.col("rank") < F.col("qid") % 5).groupBy("qid").agg(F.collect_set("doc_id").alias("allowed"))
    q = passages(spark, d).select("qid", ((F.col("qid") % 4) * 0.3).alias("confidence"), ((F.col("qid") % 3) * 0.02).alias("margin")).join(scope, "qid", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    return SE.early_exit(q, h).select("qid", "reason", "exit", (F.round("score_gap", 4) + 0.0).alias("score_gap"))


@query("query_gates", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR (doc_id % 10) / 20.0 < 0.1 OR (quality = 0 AND (doc_id % 7 < 3 OR doc_id % 9 < 4)) THEN true WHEN (doc_id % 11) / 10.0 < 0.45 AND toxic = 0 THEN false ELSE toxic = 1 OR doc_id % 7 < 3 OR doc_id % 9 < 4 OR doc_id % 13 < 6 OR doc_id % 7 < 5 END AS use_vector,
toxic = 0 AND doc_id % 3 > 0 AND doc_id % 8 >= 4 AND (doc_id % 4 <= 1 OR (doc_id % 11) / 10.0 >= 0.55 OR (doc_id % 10) / 20.0 >= 0.15) AS run_focus, round((doc_id % 11) / 10.0 + least(0.4, (doc_id % 10) / 20.0), 6) AS confidence FROM labels""")
def query_gates(spark, d):
    i = F.col("doc_id")
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("too_short"))).otherwise(F.array().cast("array<string>"))
    use = SE.vector_gate((i % 11) / 10, flags, F.lit("labor"), i % 7, i % 9, i % 13, i % 4, (i % 10) / 20, F.col("quality") == 0)
    run, confidence = SE.focus_gate((i % 11) / 10, (i % 10) / 20, i % 4, i % 8, F.when(i % 3 == 0, "hard").otherwise("none"), F.col("toxic") == 0)
    return t(spark, d, "labels").select("doc_id", use.alias("use_vector"), run.alias("run_focus"), F.round(confidence, 6).alias("confidence"))


@query("exact_retry", """SELECT doc_id AS qid, CASE WHEN quality = 1 THEN 'exact_doc' WHEN doc_id % 5 = 0 THEN 'loose' ELSE 'candidate_docs' END AS refined, CASE WHEN quality = 1 THEN '1' WHEN doc_id % 5 = 0 THEN '1' WHEN doc_id % 5 = 1 THEN '1' ELSE array_to_string(list_transform(range(2, least(doc_id % 5, 4) + 1), lambda x: CAST(x AS VARCHAR)), ',') END AS allowed, quality <> 1 AS retried FROM labels""")
def exact_retry(spark, d):
    n = F.col("doc_id") % 5
    looked = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    q = t(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.lit("exact_doc").alias("refined"), F.array(F.lit("1")).alias("allowed"), looked.alias("looked_up"))
    found = t(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("qid"))
    return SE.exact_retry(q, found).withColumn("allowed", F.array_join("allowed", ","))


@query("scope_fallback", BM25_SQL + """, sc2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r2 FROM rk WHERE qid % 2 = 0 AND doc_id % 50 = qid % 50), s AS (SELECT qid, doc_id, score, r2 - 1 AS r2 FROM sc2 WHERE r2 <= 10), e AS (SELECT item_id AS qid FROM benchmark WHERE item_id % 3 > 0 AND item_id NOT IN (SELECT qid FROM s))
SELECT qid, doc_id AS id, round(score, 4) AS score, CAST(r2 AS INT) AS rank, false AS fallback FROM s UNION ALL SELECT qid, doc_id, round(score, 4), CAST(rank AS INT), true FROM rk JOIN e USING (qid) WHERE rank < 10""")
def scope_fallback(spark, d):
    p = passages(spark, d)
    allowed = t(spark, d, "documents").select(F.col("doc_id").alias("id")).join(p.filter("qid % 2 = 0").select("qid", (F.col("qid") % 50).alias("k")), F.col("id") % 50 == F.col("k")).select("qid", "id")
    scoped = hits(spark, d, 10, allowed)
    q = p.withColumns({"scoped": F.lit(True), "has_document": F.col("qid") % 3 == 0})
    return SE.scope_fallback(index_of(spark, d), q, scoped).withColumn("score", F.round("score", 4))


@query("legacy_families", BM25_SQL + """, c AS (SELECT qid, doc_id, rank, 'luat ' || source AS family, 1.0::DOUBLE / (60 + rank) AS score FROM rk JOIN documents USING (doc_id) WHERE rank < 20), f AS (SELECT qid, family, round(sum(score), 9) AS total, min(rank) AS first FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, first, family) AS n, max(total) OVER (PARTITION BY qid) AS t1 FROM f), r2 AS (SELECT *, max(CASE WHEN n = 2 THEN total END) OVER (PARTITION BY qid) AS t2 FROM r), k AS (SELECT qid, family, n FROM r2 WHERE n <= CASE WHEN t2 IS NULL THEN 3 WHEN t1 >= t2 * 1.25 THEN 2 ELSE 3 END),
o AS (SELECT c.qid, doc_id, c.rank, row_number() OVER (PARTITION BY c.qid ORDER BY c.rank) AS m FROM c JOIN k ON c.qid = k.qid AND c.family = k.family)
SELECT qid, a.families, b.docs FROM (SELECT qid, string_agg(family, ',' ORDER BY n) AS families FROM k GROUP BY 1) a JOIN (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY m) AS docs FROM o WHERE m <= 6 GROUP BY 1) b USING (qid)""")
def legacy_families(spark, d):
    c = hits(spark, d, 20).join(units(spark, d).select("id", "doc_id", "family"), "id").withColumn("score", 1 / (60 + F.col("rank")))
    return SE.legacy_families(c).select("qid", F.array_join("families", ",").alias("families"), F.array_join("docs", ",").alias("docs"))


def plans_of(spark, d):
    return Q.rewrite(passages(spark, d)).withColumn("focus_terms", T.focus_terms(F.col("query"), list(Q.STOP)))


@query("concept_recall")
def concept_recall(spark, d):
    return SE.recall(index_of(spark, d), plans_of(spark, d)).select("qid", "id", F.round("score", 4).alias("score"), "rank", "passes")


@query("fallback_queries")
def fallback_queries(spark, d):
    p = plans_of(spark, d).select("qid", F.col("query").alias("raw"), "clean", F.col("lexical_query").alias("lexical"), F.col("strong_phrases").alias("intents"), F.col("focus_terms").alias("focus"))
    return SE.fallback_query(p)


@query("focus_rerank")
def focus_rerank(spark, d):
    h = hits(spark, d, 20).join(units(spark, d), "id").withColumn("rerank_score", 0.001 * F.col("score"))
    return SE.focus_rerank(h, plans_of(spark, d)).select("qid", "id", "rank", "original_rank", "focus_bonus")


@query("search_snapshot", FUSED_SQL.replace("FROM rk WHERE rank < 10 UNION", "FROM rk WHERE rank < 20 UNION") + """, sta AS (SELECT qid, 'bm25' AS stage, doc_id AS id, rank, score FROM rk WHERE rank < 20 UNION ALL SELECT qid, 'vector', id, rank, score FROM rv WHERE rank < 10 UNION ALL SELECT qid, 'rrf', id, rank, score FROM rf) SELECT qid, stage, id, CAST(rank AS INT) AS rank, round(score, 4) AS score, 1 AS kept, CAST(NULL AS VARCHAR) AS filter_reason FROM sta""")
def search_snapshot(spark, d):
    return snapshot_of(spark, d).filter("stage IN ('bm25', 'vector', 'rrf')").withColumn("score", F.round("score", 4))


def snapshot_of(spark, d):
    return SE.snapshot(index_of(spark, d), passages(spark, d), units(spark, d), vector_hits(spark, d), bm25_k=20)


@query("search_final")
def search_final(spark, d):
    return snapshot_of(spark, d).filter("stage IN ('deduped', 'reranked', 'final', 'filtered')")


# --- evaluation of searches ---------------------------------------------------------------------------


def eval_cases(spark, d):
    q = F.col("item_id")
    word = T.ascii_tokens(F.col("text"))
    return t(spark, d, "benchmark").select(
        q.alias("case_id"), F.element_at(F.array(*map(F.lit, ("hybrid_default", "structured_exact", "narrow_bm25"))), (q % 3 + 1).cast("int")).alias("expected_route"), F.lit("").alias("expected_doc_id"),
        F.when(q % 2 == 0, F.concat((q % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP"))).otherwise("").alias("expected_doc_number"), F.lit("luat src1").alias("expected_family"),
        F.when(q % 5 > 0, (q % 5).cast("string")).otherwise("").alias("expected_article"), F.lit("").alias("expected_clause"), F.when(q % 4 > 0, F.array_distinct(F.slice(word, 1, 2))).otherwise(F.array().cast("array<string>")).alias("focus_terms"),
    )


QUALITY_SQL = BM25_SQL + """, h AS (SELECT qid, rank + 1 AS rank, qid % 2 = 0 AND doc_id % 9 = qid % 9 AS law, starts_with(source, 'src1') AS family, qid % 5 > 0 AND doc_id % 6 = qid % 5 AS article FROM rk JOIN documents USING (doc_id) WHERE rank < 10),
r AS (SELECT qid, min(CASE WHEN law THEN rank END) AS law, coalesce(min(CASE WHEN family THEN rank END), min(CASE WHEN law THEN rank END)) AS family, min(CASE WHEN law AND article THEN rank END) AS article FROM h GROUP BY 1)
SELECT item_id AS case_id, CAST(law AS INT) AS rank_first_law, CAST(family AS INT) AS rank_first_family, CAST(article AS INT) AS rank_first_article, CAST(law IS NOT NULL AS INT) AS correct_law_top10, CAST(family IS NOT NULL AS INT) AS correct_family_top10 FROM benchmark LEFT JOIN r ON qid = item_id"""


def quality_rows(spark, d):
    return E.hit_quality(eval_cases(spark, d), hits(spark, d).join(units(spark, d), "id").withColumnRenamed("qid", "case_id"))


@query("hit_quality", QUALITY_SQL)
def hit_quality(spark, d):
    return quality_rows(spark, d).select("case_id", "rank_first_law", "rank_first_family", "rank_first_article", "correct_law_top10", "correct_family_top10")


@query("eval_run")
def eval_run(spark, d):
    """Cases searched, judged and summed by route."""
    return E.quality_rates(quality_rows(spark, d))


@query("quality_rates", """WITH x AS (SELECT source AS route, quality, toxic, doc_id FROM labels JOIN documents USING (doc_id)) SELECT route AS expected_route, count(*) AS cases, round(avg(quality), 4) AS correct_law_top10_rate, round(avg(toxic), 4) AS focus_top1_rate,
coalesce(round(avg(CASE WHEN quality = 1 THEN CAST(doc_id % 2 AS DOUBLE) END), 4), 0) AS correct_article_top10_given_law_found_rate, coalesce(round(avg(CASE WHEN doc_id % 3 = 0 THEN CAST(toxic AS DOUBLE) END), 4), 0) AS focus_top1_on_focus_cases_rate FROM x GROUP BY 1""")
def quality_rates(spark, d):
    i = F.col("doc_id")
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("expected_route", F.col("source"))
    own = {"correct_law_top10": F.col("quality"), "law_found_top10": F.col("quality"), "focus_top1": F.col("toxic"), "correct_article_top10": i % 2, "focus_case": (i % 3 == 0).cast("int")}
    rows = rows.withColumns({c: own.get(c, F.lit(0)) for c in (*E.RATES, "article_case", *own)})
    return E.quality_rates(rows).select("expected_route", "cases", "correct_law_top10_rate", "focus_top1_rate", "correct_article_top10_given_law_found_rate", "focus_top1_on_focus_cases_rate")


FAILURE_SQL = """WITH b AS (SELECT doc_id, ['hybrid_default','structured_exact','narrow_bm25','doc_scoped_hybrid_exact_doc','law_anchored_hybrid_loose'][doc_id % 5 + 1] AS e, ['hybrid_default','structured_exact','narrow_bm25','doc_scoped_hybrid_candidate_docs','law_anchored_hybrid_loose'][doc_id % 7 % 5 + 1] AS a, quality = 1 AS x, doc_id % 3 = 0 AS fam, toxic = 1 AS top, doc_id % 4 = 0 AS f1, doc_id % 4 < 2 AS f3, doc_id % 2 = 0 AS art FROM labels),
s AS (SELECT *, e = 'hybrid_default' AS de, e = 'doc_scoped_hybrid_exact_doc' AS sc, starts_with(a, 'doc_scoped_hybrid') AS ins, e IN ('law_anchored_hybrid_loose', 'hybrid_default') AND fam AS soft, a <> e AS w FROM b),
p AS (SELECT *, e = 'doc_scoped_hybrid_exact_doc' AND a = 'doc_scoped_hybrid_candidate_docs' AND x AND doc_id % 2 = 0 AS tie, e = 'law_anchored_hybrid_loose' AND a = 'doc_scoped_hybrid_candidate_docs' AND (x OR fam) AS pro FROM s),
l AS (SELECT doc_id, list_filter([CASE WHEN w AND tie THEN 'ROUTE_ACCEPTABLE_ALIAS_TIE' END, CASE WHEN w AND NOT tie AND pro THEN 'ROUTE_ACCEPTABLE_SCOPE_PROMOTION' END, CASE WHEN w AND NOT tie AND NOT pro THEN 'ROUTE_WRONG' END, CASE WHEN doc_id % 11 = 0 THEN 'SCOPED_FILTER_BROKEN' END, CASE WHEN e IN ('structured_exact', 'narrow_bm25') AND doc_id % 6 <> 0 THEN 'PARSER_DOC_NUMBER_FAIL' END, CASE WHEN (sc OR e = 'law_anchored_hybrid_loose') AND doc_id % 8 <> 0 THEN 'PARSER_LAW_NAME_FAIL' END,
CASE WHEN sc AND a = 'law_anchored_hybrid_loose' THEN 'DOC_LOOKUP_CONFIDENCE_TOO_LOW' END, CASE WHEN sc AND ins AND NOT x AND NOT fam THEN 'DOC_LOOKUP_SCOPE_WRONG' END, CASE WHEN sc AND ins AND NOT x AND fam THEN 'DOC_FAMILY_EQUIVALENT' END, CASE WHEN de AND doc_id % 9 = 0 THEN 'QUERY_TOO_VAGUE' END, CASE WHEN de AND top AND NOT x AND fam THEN 'TOPICAL_FAMILY_EQUIVALENT' END, CASE WHEN de AND top AND NOT x AND NOT fam THEN 'TOPICAL_RETRIEVAL_OK_BUT_NOT_EXACT' END, CASE WHEN de AND NOT top AND NOT f3 THEN 'BM25_NOT_FOCUSED' END, CASE WHEN de AND f3 AND NOT f1 THEN 'RERANK_BAD_TOP1' END,
CASE WHEN NOT de AND NOT x AND soft THEN 'DOC_FAMILY_EQUIVALENT' END, CASE WHEN NOT de AND NOT x AND NOT soft AND e = 'structured_exact' THEN 'LOOKUP_DOC_MISS' END, CASE WHEN NOT de AND NOT x AND NOT soft AND e <> 'structured_exact' THEN 'BM25_NOT_FOCUSED' END, CASE WHEN NOT de AND x AND NOT art AND e = 'structured_exact' THEN 'LOOKUP_ARTICLE_MISS' END, CASE WHEN NOT de AND x AND NOT art AND e <> 'structured_exact' THEN 'BM25_NOT_FOCUSED' END, CASE WHEN NOT de AND x AND art AND NOT f1 THEN 'RERANK_BAD_TOP1' END, CASE WHEN NOT f1 AND doc_id % 5 <> 1 AND x AND NOT de THEN 'VECTOR_NOISE' END], lambda v: v IS NOT NULL) AS ls FROM p)"""


def failures(spark, d):
    i = F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    rows = t(spark, d, "labels").select(
        "doc_id", pick(["hybrid_default", "structured_exact", "narrow_bm25", "doc_scoped_hybrid_exact_doc", "law_anchored_hybrid_loose"], i % 5).alias("expected_route"),
        pick(["hybrid_default", "structured_exact", "narrow_bm25", "doc_scoped_hybrid_candidate_docs", "law_anchored_hybrid_loose"], i % 7 % 5).alias("actual_route"), F.col("quality").alias("correct_law_top10"), (i % 3 == 0).cast("int").alias("correct_family_top10"),
        F.when(i % 2 == 0, "candidate_low_margin_or_tie").otherwise("").alias("selected_reason"), F.lit(1).alias("allowed_docs"), (i % 11 == 0).alias("scoped_filter_broken"), F.lit("1/2024").alias("expected_doc_number"), (i % 6 == 0).alias("has_doc_ref"), (i % 8 == 0).alias("has_law_name"),
        (i % 9 == 0).alias("query_too_vague"), F.col("toxic").alias("topical_doc_top10"), (i % 4 == 0).cast("int").alias("focus_top1"), (i % 4 < 2).cast("int").alias("focus_top3"), (i % 2 == 0).cast("int").alias("correct_article_top10"), F.lit("1").alias("expected_article"), (i % 5 == 1).alias("vector_skipped"),
    )
    found, primary = E.labels(E.failure_tests())
    return rows.select("doc_id", found.alias("labels"), primary.alias("primary_label"))


@query("failure_labels", FAILURE_SQL + " SELECT doc_id, array_to_string(list_sort(list_distinct(ls)), ',') AS labels, coalesce(ls[1], 'PASS') AS primary_label FROM l")
def failure_labels(spark, d):
    return failures(spark, d).withColumn("labels", F.array_join(F.array_sort("labels"), ","))


@query("mode_shares", FAILURE_SQL + ", m AS (SELECT coalesce(ls[1], 'PASS') AS label, count(*) AS n FROM l GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 4) AS share, NOT starts_with(label, 'ROUTE_ACCEPTABLE') AND label <> 'PASS' AS true_failure FROM m")
def mode_shares(spark, d):
    return E.mode_shares(failures(spark, d))


# --- further joins of the corpus build ------------------------------------------------------------------


def matched_meta(spark, d):
    """Labelled documents of label 1 as matched metadata."""
    text = lambda x: F.col(x).cast("string")
    df = t(spark, d, "documents").join(t(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return df.select(F.col("doc_id").alias("id"), F.concat(F.lit(" t "), text("doc_id")).alias("title"), text("n_chars").alias("document_number"), F.col("lang").alias("legal_type"), F.col("source").alias("issuing_authority"), F.lit("").alias("issuance_date"), F.lit("u ").alias("url"), F.lit(None).cast("string").alias("signers"), F.col("source").alias("legal_sectors"))


@query("join_fallback", "SELECT 'doc_' || doc_id AS doc_id, 't ' || doc_id AS title, coalesce(lang, '') AS doc_type, length(text) AS n FROM documents WHERE length(text) >= 50 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_fallback(spark, d):
    content = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return C.join_fallback(content, matched_meta(spark, d)).select("doc_id", "title", "doc_type", F.length("content").cast("long").alias("n"))


@query("join_crawl", r"SELECT 't ' || doc_id AS title, 'u' AS url, lang AS loai_van_ban, source AS co_quan, CAST(NULL AS VARCHAR) AS tinh_trang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_crawl(spark, d):
    content = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return C.join_crawl(content, matched_meta(spark, d)).select("title", "url", "meta.loai_van_ban", "meta.co_quan", "meta.tinh_trang")


@query("exact_samples", """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS VARCHAR) AS article, l_returnflag AS clause, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem), t AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderkey % 4 AS VARCHAR) AS article, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE '' END AS clause FROM orders)
SELECT t.doc_id, t.article, t.clause, min(chunk_id) AS chunk_id FROM t JOIN c ON c.doc_id = t.doc_id AND c.article = t.article AND (t.clause = '' OR t.clause = c.clause) GROUP BY ALL""")
def exact_samples(spark, d):
    chunks = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("string").alias("article"), F.col("l_returnflag").alias("clause"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    k = F.col("o_orderkey")
    return C.exact_samples(chunks, t(spark, d, "orders").select(k.cast("string").alias("doc_id"), (k % 4).cast("string").alias("article"), F.when(k % 2 == 0, "N").otherwise("").alias("clause")))


@query("extracted_title")
def extracted_title(spark, d):
    head = F.concat(F.lit("QUỐC HỘI\nLUẬT\n"), F.upper(F.substring("text", 1, 40)), F.lit("\n\n"), F.col("text"))
    return texts(spark, d).select("doc_id", R.extracted_title(head, F.lit("Luật"), F.col("doc_id").cast("string")).alias("title"))


# --- legal texts and questions over all documents -------------------------------------------------------
# The driver's prose has no articles, so every 200 characters of a document lend their words to a law of a known form; each fifth document stays as it is.

PIECES_SQL = """WITH o AS (SELECT doc_id AS o, text, unnest(range(0, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE greatest(1, CAST(ceil(length(text) / 200.0) AS BIGINT)) END)) AS i FROM documents),
p0 AS (SELECT (o * 1000000 + i) * 5 + o % 5 AS doc_id, CASE WHEN o % 5 = 0 THEN text ELSE substr(text, i * 200 + 1, 200) END AS text FROM o),
p AS (SELECT doc_id, text, trim(regexp_replace(substr(text, 1, 40), '[^a-zA-Z]+', ' ', 'g')) AS t1, trim(regexp_replace(substr(text, 41, 80), '[^a-zA-Z]+', ' ', 'g')) AS a, trim(regexp_replace(substr(text, 121, 80), '[^a-zA-Z]+', ' ', 'g')) AS b FROM p0),
l AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'Chương I. Chung' || chr(10) || 'Mục 1. ' || a || 'v' || chr(10) || 'Điều 1. ' || t1 || '.' || chr(10) || '1. ' || a || 'x' || chr(10) || 'a) ' || b || 'y' || chr(10) || '2. ' || b || 'z' || chr(10) || 'Chương II' || chr(10) || 'Điều 2a. ' || b || 'w' || chr(10) || 'Nội dung ' || a || 'k' END AS content FROM p)"""


PIECE_CHARS = 200


def pieces(spark, d):
    """(doc_id, text, t1, a, b): the laws' numbers keep the document's remainder by 5."""
    part = lambda a, n: F.trim(F.regexp_replace(F.substring("text", a, n), "[^a-zA-Z]+", " "))
    i, n = F.col("doc_id"), PIECE_CHARS
    cut = F.when((i % 5 > 0) & (F.length("text") > n), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{n}}}"), F.lit(0))).otherwise(F.array("text"))  # in one scan; no piece carries the text that it is from
    rows = texts(spark, d).select("doc_id", F.posexplode(cut).alias("i", "text"))
    rows = rows.select(((i * 1_000_000 + F.col("i")) * 5 + i % 5).alias("doc_id"), "text")
    return rows.select("doc_id", "text", part(1, 40).alias("t1"), part(41, 80).alias("a"), part(121, 80).alias("b"))


def law_docs(spark, d):
    c = F.col
    made = F.concat(
        F.lit("Chương I. Chung\nMục 1. "), c("a"), F.lit("v\nĐiều 1. "), c("t1"), F.lit(".\n1. "), c("a"), F.lit("x\na) "), c("b"), F.lit("y\n2. "), c("b"), F.lit("z\nChương II\nĐiều 2a. "), c("b"), F.lit("w\nNội dung "), c("a"), F.lit("k"),
    )
    return pieces(spark, d).select(
        "doc_id", c("t1").alias("title"), F.concat((c("doc_id") % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP")).alias("document_number"), F.lit("Nghị định").alias("doc_type"), F.lit("").alias("issuer"), F.lit("").alias("issue_date"),
        F.when(c("doc_id") % 5 == 0, c("text")).otherwise(made).alias("content"), "t1", "a", "b",
    )


@query("parse_articles", PIECES_SQL + """ SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS article_no, '1' AS article, t1 AS title, 'Chương I. Chung' AS chapter, 'Mục 1. ' || a || 'v' AS section, 2 AS clauses, b || 'y' AS point FROM l WHERE doc_id % 5 > 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, '2a', b || 'w', 'Chương II', 'Mục 1. ' || a || 'v', 0, NULL FROM l WHERE doc_id % 5 > 0""")
def parse_articles(spark, d):
    found = L.articles(law_docs(spark, d))
    point = F.regexp_replace(F.get(F.get("clauses", F.lit(0))["points"], F.lit(0))["text"], r"^a\) ", "")
    return found.select("doc_id", "article_no", "article", "title", "chapter", "section", F.size("clauses").alias("clauses"), point.alias("point"))


@query("legal_chunks", PIECES_SQL + r""", w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM l WHERE doc_id % 5 = 0), n AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 682 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 682) / 640.0) AS INT) END AS c FROM w), x AS (SELECT doc_id, ws, c, unnest(range(0, c)) AS i FROM n),
r AS (SELECT doc_id || '_d1_k1' AS chunk_id, '1' AS article, '1' AS clause, trim('Điều 1. ' || t1) || chr(10) || chr(10) || '1. ' || a || 'x' || chr(10) || 'a) ' || b || 'y' AS text FROM l WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id || '_d1_k2', '1', '2', trim('Điều 1. ' || t1) || chr(10) || chr(10) || '2. ' || b || 'z' || chr(10) || 'Chương II' FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id || '_d2a', '2a', '', 'Điều 2a. ' || b || 'w' || chr(10) || 'Nội dung ' || a || 'k' FROM l WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id || CASE WHEN c = 1 THEN '_full' ELSE '_w' || i END, '', '', array_to_string(ws[i * 640 + 1 : i * 640 + 682], ' ') FROM x) SELECT *, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.5) AS INT) AS token_count FROM r""")
def legal_chunks(spark, d):
    return L.chunks(law_docs(spark, d)).select("chunk_id", "article", "clause", "text", "token_count")


@query("footer_cut", PIECES_SQL + " SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN length(content) + 1 ELSE length(content) END AS INT) AS footer_start, CAST(strpos(content, 'Điều 1.') - 1 AS INT) AS header_end FROM l WHERE doc_id % 5 > 0")
def footer_cut(spark, d):
    x = law_docs(spark, d).filter("doc_id % 5 > 0").withColumn("content", F.concat("content", F.when(F.col("doc_id") % 3 == 0, "\nNơi nhận:\n- A").otherwise("")))
    return x.select("doc_id", L.footer_start(F.col("content")).alias("footer_start"), L.header_end(F.col("content")).alias("header_end"))


@query("breadcrumb", PIECES_SQL + " SELECT doc_id, CASE WHEN length(a) > 60 THEN substr(a, 1, 57) || '...' ELSE a END || ' > Chương I' || CASE WHEN t1 = '' THEN '' ELSE ' > ' || t1 END || ' > Điều ' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN ' > Khoản 2' ELSE '' END AS path FROM l")
def breadcrumb(spark, d):
    i = F.col("doc_id")
    return law_docs(spark, d).select("doc_id", L.breadcrumb(F.col("a"), F.lit("Chương I. QUY ĐỊNH CHUNG"), F.col("t1"), (i % 7).cast("string"), F.when(i % 2 == 0, "2").otherwise("")).alias("path"))


#: Forms of number and title, and the kind of document that each stands for: every rule once, in order.
KINDS = [
    ("1/2024/QĐ-UBND", "", "quyet_dinh_ubnd"), ("2/NQ-HĐND", "", "van_ban_dia_phuong"), ("CV-3", "", "cong_van"), ("4/VBHN-VPQH", "", "vbhn"), ("5/2024/NĐ-CP", "", "nghi_dinh"), ("6/2024/TT-BTC", "", "thong_tu"), ("7/2024/QH15", "", "luat"),
    ("8/L-CTN", "", "bo_luat"), ("", "Công văn", "cong_van"), ("", "Quyết định UBND", "quyet_dinh_ubnd"), ("", "Nghị quyết tỉnh", "van_ban_dia_phuong"), ("", "Văn bản hợp nhất", "vbhn"), ("", "Nghị định", "nghi_dinh"), ("", "Bộ luật", "bo_luat"),
    ("", "Luật", "luat"), ("", "Thông tư", "thong_tu"), ("", "khác", ""),
]


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _pick(items, k):
    return F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))


def kinds_of(spark, d):
    k = F.col("doc_id") % len(KINDS)
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", "q ")  # whole texts, none of whose words is one of a rule's
    return texts(spark, d).select("doc_id", _pick([x[0] for x in KINDS], k).alias("number"), F.concat_ws(" ", _pick([x[1] for x in KINDS], k), F.concat(words, F.lit("q"))).alias("title"))


@query("doc_type_bucket", f"SELECT doc_id, {_sql_list([x[2] for x in KINDS])}[doc_id % {len(KINDS)} + 1] AS kind FROM documents")
def doc_type_bucket(spark, d):
    return kinds_of(spark, d).select("doc_id", S.bucket(F.col("number"), F.lit(""), F.col("title"), F.lit("")).alias("kind"))


ROLES = {"luat": "law_core", "bo_luat": "law_core", "vbhn": "consolidated", "nghi_dinh": "implementation", "thong_tu": "implementation", "quyet_dinh_ubnd": "local_admin", "van_ban_dia_phuong": "local_admin", "cong_van": "guidance", "": "unknown"}


@query("doc_roles", f"SELECT doc_id, {_sql_list([ROLES[x[2]] for x in KINDS])}[doc_id % {len(KINDS)} + 1] AS role, {_sql_list([x[2] for x in KINDS])}[doc_id % {len(KINDS)} + 1] IN ('luat', 'bo_luat', 'nghi_dinh', 'vbhn', 'thong_tu') AS preferred, doc_id % {len(KINDS)} IN (0, 1, 8, 9) AS local FROM documents")
def doc_roles(spark, d):
    n, ti, e = F.col("number"), F.col("title"), F.lit("")
    kind = S.bucket(n, e, ti, e)
    return kinds_of(spark, d).select("doc_id", S.role(kind, ti, e).alias("role"), S.preferred(kind, ti, e, e).alias("preferred"), S.local_admin(n, e, ti, e).alias("local"))


TITLES_SQL = PIECES_SQL + """, h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Luật ' || t1 || ' sửa đổi năm 2019' WHEN 1 THEN 'Văn bản hợp nhất Bộ luật ' || t1 ELSE t1 || ' nghị định 1999' END AS title FROM l)"""


@query("family_key", TITLES_SQL + r""", a AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(translate(strip_accents(title), 'đĐ', 'dD')), '[0-9a-z]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')), ' ') AS v FROM h),
b AS (SELECT doc_id, regexp_replace(regexp_replace(v, '\bvan ban hop nhat\b', ' ', 'g'), '\b(sua doi|bo sung|hop nhat)\b', ' ', 'g') AS v FROM a), c AS (SELECT doc_id, CASE WHEN regexp_matches(v, '\b(bo luat|luat)\b\s+.+') THEN regexp_extract(v, '\b((?:bo luat|luat)\b\s+.+)', 1) ELSE v END AS v FROM b)
SELECT doc_id, trim(regexp_replace(regexp_replace(v, '\b(19|20)[0-9][0-9]\b', ' ', 'g'), '\s+', ' ', 'g')) AS family FROM c""")
def family_key(spark, d):
    k, x = F.col("doc_id") % 3, F.col("t1")
    title = F.when(k == 0, F.concat(F.lit("Luật "), x, F.lit(" sửa đổi năm 2019"))).when(k == 1, F.concat(F.lit("Văn bản hợp nhất Bộ luật "), x)).otherwise(F.concat(x, F.lit(" nghị định 1999")))
    return pieces(spark, d).select("doc_id", T.family_key(title).alias("family"))


ASKED_SQL = """WITH q AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'structured_exact' WHEN 1 THEN 'narrow_bm25' WHEN 2 THEN 'narrow_bm25' WHEN 3 THEN 'narrow_bm25' WHEN 4 THEN 'law_anchored_hybrid' ELSE 'hybrid_default' END AS route,
CASE doc_id % 6 WHEN 0 THEN doc_id || '/2022/ND-CP' WHEN 1 THEN doc_id || '/2025/QD-UBND' ELSE '' END AS number, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id % 50 + 1 AS VARCHAR) WHEN 2 THEN '12a' ELSE '' END AS article, CASE WHEN doc_id % 6 = 2 THEN '3' ELSE '' END AS clause, CASE doc_id % 6 WHEN 3 THEN 'luat dat dai' WHEN 4 THEN 'luat dat dai giai quyet tranh chap boi thuong' ELSE '' END AS law FROM documents)"""


def doc_questions(spark, d):
    i = F.col("doc_id")
    n = i.cast("string")
    return t(spark, d, "documents").select("doc_id", (
        F.when(i % 6 == 0, F.concat(F.lit("Điều "), (i % 50 + 1).cast("string"), F.lit(" Nghị định "), n, F.lit("/2022/NĐ-CP quy định gì?"))).when(i % 6 == 1, F.concat(F.lit("Nội dung "), n, F.lit("/2025/QĐ-UBND")))
        .when(i % 6 == 2, F.lit("khoản 3 Điều 12a")).when(i % 6 == 3, F.lit("Luật Đất đai")).when(i % 6 == 4, F.lit("Luật Đất đai giải quyết tranh chấp bồi thường quy định thế nào")).otherwise(F.lit("ai được xét tặng huân chương hạng nhất"))
    ).alias("query"))


@query("route_decision", ASKED_SQL + " SELECT doc_id, route FROM q")
def route_decision(spark, d):
    return doc_questions(spark, d).select("doc_id", RT.route(F.col("query")).alias("route"))


@query("legal_refs", ASKED_SQL + " SELECT doc_id, number AS document_number, article AS article_number, clause AS clause_number, law AS law_name FROM q")
def legal_refs(spark, d):
    return doc_questions(spark, d).select("doc_id", R.legal_refs(F.col("query")).alias("refs")).select("doc_id", "refs.document_number", "refs.article_number", "refs.clause_number", "refs.law_name")


@query("rewrite_plan")
def rewrite_plan(spark, d):
    return Q.rewrite(doc_questions(spark, d).withColumnRenamed("doc_id", "qid"))


@query("recall_passes")
def recall_passes(spark, d):
    return Q.recall_passes(rewrite_plan(spark, d))


@query("law_lookup", PIECES_SQL + r""", q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[a-z0-9]+')[1:4]) AS ws FROM benchmark), qw AS (SELECT qid, len(ws) AS n, unnest(ws) AS w FROM q), tw AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS w FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(a || ' ' || b), '[a-z0-9]+')) AS ws FROM l)),
s AS (SELECT qid, doc_id, count(*) / max(n) AS confidence, max(size) AS size FROM qw JOIN tw USING (w) GROUP BY ALL HAVING count(*) / max(n) >= 0.65), r AS (SELECT *, row_number() OVER v AS rank, confidence - coalesce(lead(confidence) OVER v, 0) AS margin FROM s WINDOW v AS (PARTITION BY qid ORDER BY confidence DESC, size, doc_id)) SELECT qid, doc_id, round(confidence, 6) AS confidence, round(margin, 6) AS margin, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def law_lookup(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.ascii_tokens(F.col("text")), 1, 4), " ").alias("law_name"))
    found = RT.law_lookup(q, pieces(spark, d).select("doc_id", F.concat_ws(" ", "a", "b").alias("title")))
    return found.select("qid", "doc_id", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "rank")


#: Bytes of a query's number and references in a broadcast side.
ASKED_BYTES = 512


@query("structured_lookup", PIECES_SQL + """, c AS (SELECT doc_id || '_d1_k1' AS chunk_id, doc_id, '1' AS article, '1' AS clause FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id || '_d1_k2', doc_id, '1', '2' FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id || '_d2a', doc_id, '2a', '' FROM l WHERE doc_id % 5 > 0),
q AS (SELECT item_id AS qid, item_id % 9 AS n, CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 4 = 3 THEN '2a' ELSE '1' END AS qa, CASE WHEN item_id % 4 = 2 THEN '2' ELSE '' END AS qc FROM benchmark)
SELECT qid, chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN qa <> '' AND qa = article AND qc <> '' AND qc = clause THEN 'clause' WHEN qa <> '' AND qa = article THEN 'article' ELSE 'document' END AS match_type FROM q JOIN c ON c.doc_id % 9 = n WHERE qa = '' OR qa = article""")
def structured_lookup(spark, d):
    i = F.col("item_id")
    named = F.concat(F.when(i % 4 == 2, "Khoản 2 ").otherwise(""), F.when(i % 4 == 0, "").when(i % 4 == 3, "Điều 2a ").otherwise("Điều 1 "), F.lit("Nghị định "), (i % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP"))
    q = t(spark, d, "benchmark").select(i.alias("qid"), R.legal_refs(named).alias("refs"))
    few = t(spark, d, "benchmark").count() * ASKED_BYTES <= V.BROADCAST_BYTES
    return RT.structured_lookup(q, L.chunk_keys(law_docs(spark, d).filter("doc_id % 5 > 0")), few)


HEADS = [("QUỐC HỘI", "Luật", "Quốc hội"), ("CHÍNH PHỦ", "Nghị định", "Chính phủ"), ("BỘ NỘI VỤ", "Thông tư", "Bộ Nội vụ"), ("CHÍNH PHỦ", "Nghị quyết", "Chính phủ")]


@query("imported_fields", f"""SELECT doc_id, doc_id || '/2024/NĐ-CP' AS number, {_sql_list([x[1] for x in HEADS])}[doc_id % 4 + 1] AS doc_type, {_sql_list([x[2] for x in HEADS])}[doc_id % 4 + 1] AS issuer, '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS issue_date FROM documents""")
def imported_fields(spark, d):
    i, n = F.col("doc_id"), F.lit("\n")
    head = F.concat(_pick([x[0] for x in HEADS], i % 4), n, F.lit("Số: "), i.cast("string"), F.lit("/2024/NĐ-CP\nHà Nội, ngày "), (i % 28 + 1).cast("string"), F.lit(" tháng "), (i % 12 + 1).cast("string"), F.lit(" năm 2024\n"), F.upper(_pick([x[1] for x in HEADS], i % 4)), n, F.col("text"))
    x = t(spark, d, "documents").select("doc_id", head.alias("c"))
    return x.select("doc_id", R.extracted_number(F.col("c")).alias("number"), R.document_type(F.col("c"), F.lit("x.txt")).alias("doc_type"), R.issuer(F.col("c")).alias("issuer"), R.iso_date(F.col("c")).alias("issue_date"))


@query("query_language", r"""WITH x AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(lower(text), '[^ăâđêôơưà-ãè-éì-íò-õù-úýẠ-ỹ]', '', 'g')) AS marked, regexp_extract_all(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[a-z0-9]+') AS ts FROM documents)
SELECT doc_id, CASE WHEN letters = 0 THEN 'mixed' WHEN marked / letters > 0.05 THEN 'vi' WHEN len(list_filter(ts, lambda w: list_contains(%s, w))) / greatest(len(ts), 1) > 0.35 OR regexp_matches(array_to_string(ts, ' '), '\b(luat|nghi dinh|thong tu|dieu|khoan|quy dinh)\b') THEN 'vi_no_accent' ELSE 'en' END AS language FROM x""" % _sql_list(T.KNOWN_UNACCENTED))
def query_language(spark, d):
    return texts(spark, d).select("doc_id", T.query_language(F.col("text")).alias("language"))


@query("page_links", r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["\x27]([^"\x27]+)["\x27]', 1) AS hs FROM pages), x AS (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
n AS (SELECT page_id, i, regexp_replace(regexp_replace(trim(CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN starts_with(h, '/') THEN 'https://example.org' || h ELSE 'https://example.org/' || h END), '[#?].*$', ''), '/+$', '') AS url FROM x), f AS (SELECT page_id, url, min(i) AS i FROM n GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS i, url FROM f""")
def page_links(spark, d):
    return texts(spark, d, "pages").select("page_id", F.posexplode(C.page_links(F.col("html"), "https://example.org")).alias("i", "url"))


@query("document_gate", BM25_SQL + """, h AS (SELECT qid, doc_id AS id, rank, ['luat', 'nghi_dinh', 'cong_van', 'quyet_dinh_ubnd'][doc_id % 4 + 1] AS kind, doc_id % 4 = 3 AS loc, doc_id % 4 < 2 AS pre FROM rk WHERE rank < 20), g AS (SELECT *, NOT (kind = 'cong_van' OR (loc AND NOT pre)) AS p1 FROM h),
f AS (SELECT *, count(*) FILTER (p1) OVER (PARTITION BY qid) AS k1, count(*) FILTER (pre) OVER (PARTITION BY qid) AS np, row_number() OVER (PARTITION BY qid ORDER BY pre DESC, rank) AS rp, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rr FROM g),
s AS (SELECT *, p1 OR (k1 = 0 AND CASE WHEN np > 0 THEN pre AND rp <= 5 ELSE rr <= 3 END) AS p2 FROM f), o AS (SELECT *, p2 AND (kind IN ('luat', 'nghi_dinh') OR pre) AS good FROM s), n AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY qid) >= 3 AS narrow FROM o)
SELECT qid, id, CAST(rank AS INT) AS rank, kind FROM n WHERE CASE WHEN narrow THEN good ELSE p2 END""")
def document_gate(spark, d):
    i = F.col("id")
    h = hits(spark, d, 20).withColumns({"kind": _pick(["luat", "nghi_dinh", "cong_van", "quyet_dinh_ubnd"], i % 4), "local": i % 4 == 3, "preferred": i % 4 < 2, "allow": F.array(F.lit("luat")), "exclude": F.array(F.lit("cong_van")), "prior": F.array(F.lit("luat"), F.lit("nghi_dinh"))})
    return S.document_gate(h).select("qid", "id", "rank", "kind")


# --- smaller operators over hits, cases and logs -----------------------------------------------------------


@query("scope_violations", BM25_SQL + " SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS outside FROM rk WHERE rank < 10 AND doc_id % 3 <> qid % 3 GROUP BY 1")
def scope_violations(spark, d):
    h = hits(spark, d)
    return V.scope_violations(h, h.filter(F.col("id") % 3 == F.col("qid") % 3)).select("qid", F.array_join("outside", ",").alias("outside"))


@query("final_positions", BM25_SQL + " SELECT qid, doc_id AS id, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS INT) AS rank, CASE WHEN rank < 3 THEN round(score, 4) ELSE 0 END AS score FROM rk WHERE rank < 6")
def final_positions(spark, d):
    h = hits(spark, d, 6)
    ids = h.groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return V.final_positions(ids, h.filter("rank < 3")).withColumn("score", F.round("score", 4))


@query("case_hits", BM25_SQL + """ SELECT qid AS case_id, doc_id AS id, contains(lower(doc_id || ' Luật ' || source || ' 2020 ' || (doc_id % 9 + 1) || '/2024/NĐ-CP'), CAST(qid % 40 AS VARCHAR)) AS doc_ok, contains(trim(CASE WHEN doc_id % 6 > 0 THEN doc_id % 6 || ' ' ELSE ' ' END || CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS VARCHAR) ELSE '' END), CAST(qid % 5 + 1 AS VARCHAR)) AND qid % 2 = 0 AS article_ok,
contains(lower(doc_id || ' Luật ' || source || ' 2020 ' || (doc_id % 9 + 1) || '/2024/NĐ-CP'), CAST(qid % 40 AS VARCHAR)) AND (qid % 2 <> 0 OR contains(trim(CASE WHEN doc_id % 6 > 0 THEN doc_id % 6 || ' ' ELSE ' ' END || CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS VARCHAR) ELSE '' END), CAST(qid % 5 + 1 AS VARCHAR))) AS ok FROM rk JOIN documents USING (doc_id) WHERE rank < 10""")
def case_hits(spark, d):
    q = F.col("qid")
    cases = passages(spark, d).select(q.alias("case_id"), (q % 40).cast("string").alias("expected_doc_id"), F.when(q % 2 == 0, (q % 5 + 1).cast("string")).otherwise("").alias("expected_article_ref"))
    h = hits(spark, d).join(units(spark, d).withColumn("path", F.lit("")), "id").withColumnRenamed("qid", "case_id")
    return E.case_hits(cases, h).select("case_id", "id", "doc_ok", "article_ok", "ok")


@query("context_blocks", BM25_SQL + " SELECT qid, string_agg('[' || (rank + 1) || '] Luật ' || source || ' 2020' || chr(10) || substr(text, 1, 100), chr(10) || chr(10) ORDER BY rank) AS context FROM rk JOIN documents USING (doc_id) WHERE rank < 3 GROUP BY 1")
def context_blocks(spark, d):
    h = hits(spark, d, 3).join(units(spark, d).withColumn("text", F.substring("text", 1, 100)), "id")
    return TR.context_blocks(h)


@query("hit_sources", BM25_SQL + " SELECT qid, doc_id % 7 AS doc_id, CAST(min(rank) AS INT) AS rank FROM rk WHERE rank < 10 GROUP BY ALL")
def hit_sources(spark, d):
    return TR.sources(hits(spark, d).withColumn("doc_id", F.col("id") % 7)).select("qid", "doc_id", "rank")


@query("law_order", BM25_SQL + " SELECT qid, doc_id AS id, CAST(CASE WHEN max(p) OVER (PARTITION BY qid) > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY p DESC, s DESC, rank) - 1 ELSE rank END AS INT) AS new_rank FROM (SELECT *, round(score, 6) AS s, CASE WHEN qid % 4 = 0 THEN 0 ELSE doc_id % 3 END AS p FROM rk WHERE rank < 10)")
def law_order(spark, d):
    h = hits(spark, d).withColumns({"score": F.round("score", 6), "priority": F.when(F.col("qid") % 4 == 0, 0).otherwise(F.col("id") % 3)})
    return S.law_order(h).select("qid", "id", "new_rank")


@query("refined_route", """WITH x AS (SELECT doc_id AS qid, (doc_id % 20) * 0.05 + 0.02 AS c, (doc_id % 3) * 0.1 AS m FROM documents), k AS (SELECT *, CASE WHEN c >= 0.92 AND m >= 0.10 THEN 'exact_doc' WHEN c >= 0.75 THEN 'candidate_docs' ELSE 'loose' END AS refined FROM x)
SELECT qid, refined, CASE refined WHEN 'exact_doc' THEN 'd1' WHEN 'candidate_docs' THEN 'd1,d2' ELSE '' END AS allowed FROM k""")
def refined_route(spark, d):
    q = t(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    h = q.withColumns({"doc_id": F.concat(F.lit("d"), F.col("rank").cast("string")), "confidence": F.round((F.col("qid") % 20) * 0.05 + 0.02, 4), "margin": F.round((F.col("qid") % 3) * 0.1, 4)})
    return RT.refined_route(h).withColumn("allowed", F.array_join("allowed", ","))


@query("implementation_bridge", BM25_SQL + """, c AS (SELECT qid, doc_id, rank + 1 AS rank, doc_id % 2 = 1 AS im FROM rk WHERE rank < 10), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM c WHERE im AND rank > 3 AND qid % 3 = 0)
SELECT qid, doc_id, CAST(rank AS INT) AS rank FROM c WHERE rank <= 3 UNION ALL SELECT qid, doc_id, CAST(rank AS INT) FROM m WHERE n <= 2""")
def implementation_bridge(spark, d):
    c = hits(spark, d).select("qid", F.col("id").alias("doc_id"), (F.col("rank") + 1).alias("rank"), F.struct(F.when(F.col("id") % 2 == 1, "implementation").otherwise("law_core").alias("role")).alias("s"))
    trusted = passages(spark, d).select("qid", (F.col("qid") % 3 == 0).alias("trusted"), F.lit(0.2).alias("margin"))
    return S.implementation_bridge(c, trusted, 3)


@query("acceptance_gates", "WITH m AS (SELECT 'grounded' AS metric, round(avg(quality), 4) AS value FROM labels UNION ALL SELECT 'garbage_rate', round(avg(toxic), 4) FROM labels UNION ALL SELECT 'p95_ms', CAST(max(doc_id) AS DOUBLE) FROM labels) SELECT metric, value, CAST(CASE metric WHEN 'grounded' THEN 0.75 WHEN 'garbage_rate' THEN 0.5 ELSE 5000 END AS DOUBLE) AS threshold, CASE metric WHEN 'grounded' THEN value >= 0.75 WHEN 'garbage_rate' THEN value <= 0.5 ELSE value <= 5000 END AS met FROM m")
def acceptance_gates(spark, d):
    one = t(spark, d, "labels").agg(F.round(F.avg("quality"), 4).alias("grounded"), F.round(F.avg("toxic"), 4).alias("garbage_rate"), F.max("doc_id").cast("double").alias("p95_ms"))
    return E.gates(one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value")))


@query("sector_tags", "SELECT doc_id, coalesce(nullif(array_to_string(list_sort(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'english' END, CASE WHEN contains(lower(text), 'und') OR contains(lower(text), 'der') THEN 'german' END, CASE WHEN contains(lower(source), 'src1') THEN 'first' END], lambda x: x IS NOT NULL)), ','), ''), 'other') AS tags FROM documents")
def sector_tags(spark, d):
    found = R.sectors(F.col("text"), F.col("source"), {"english": ["the"], "german": ["und", "der"]}, "other")
    own = F.when(F.contains(F.lower("source"), F.lit("src1")), F.array(F.lit("first"))).otherwise(F.array().cast("array<string>"))
    tags = F.array_sort(F.concat(F.filter(found, lambda x: x != "other"), own))
    return texts(spark, d).select("doc_id", F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise("other").alias("tags"))


@query("answer_citations", "SELECT doc_id, 'khoản ' || (doc_id % 3 + 1) || ' điều ' || doc_id || ',điều 7,' || doc_id || '/2024/nđ-cp' AS citations, 'B,a,A' AS contexts FROM documents WHERE doc_id <> 7")
def answer_citations(spark, d):
    n = F.col("doc_id").cast("string")
    x = F.concat(F.lit("Theo Khoản "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(" Điều "), n, F.lit(" và điều 7, ĐIỀU 7 của "), n, F.lit("/2024/NĐ-CP"))
    contexts = R.context_citations(F.array(F.lit("B"), F.lit(" a"), F.lit("A"), F.lit("B"), F.lit(""), F.lit(None).cast("string")))
    return t(spark, d, "documents").filter("doc_id <> 7").select("doc_id", F.array_join(R.answer_citations(x), ",").alias("citations"), F.array_join(contexts, ",").alias("contexts"))


@query("plan_rows", "SELECT doc_id, 'o' || doc_id AS org, CAST(doc_id AS INT) AS docs, CAST(ceil(doc_id / 20.0) AS INT) AS pages FROM documents UNION ALL SELECT doc_id, 'x', 41, 3 FROM documents")
def plan_rows(spark, d):
    n = F.col("doc_id").cast("string")
    plan = F.concat(n, F.lit(",https://e.org/list?org=o"), n, F.lit("&page=1;41, https://e.org/list?org=x; "))
    return t(spark, d, "documents").select("doc_id", F.explode(R.plan_rows(plan)).alias("p")).select("doc_id", "p.*")


@query("url_parts", "SELECT page_id, 'o' || page_id AS org, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS INT) ELSE 1 END AS page FROM pages")
def url_parts(spark, d):
    n = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://e.org/list?org=o"), n, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&page="), n)).otherwise(F.lit("&x=1")))
    return t(spark, d, "pages").select("page_id", T.url_parts(url).alias("u")).select("page_id", "u.*")


@query("url_pages", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def url_pages(spark, d):
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/van-ban/x.aspx").otherwise("/tin-tuc/x.aspx"))
    return t(spark, d, "pages").filter(C.url_tests(url)["document_page"]).select("page_id")


@query("trace_detail", """WITH r AS (SELECT user_id AS trace_id, min(ts) AS started FROM events GROUP BY 1), e AS (SELECT user_id AS trace_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS events FROM events GROUP BY 1), h AS (SELECT user_id AS trace_id, string_agg(event_type || ':' || (event_id % 5), ',' ORDER BY event_type, event_id % 5, event_id) AS hits FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT trace_id, events, hits FROM r LEFT JOIN e USING (trace_id) LEFT JOIN h USING (trace_id)""")
def trace_detail(spark, d):
    e = t(spark, d, "events").withColumnRenamed("user_id", "trace_id")
    stages = e.select("trace_id", "event_id", F.col("event_type").alias("stage"), F.lit("").alias("payload"))
    h = e.filter("event_id % 2 = 0").select("trace_id", F.col("event_type").alias("stage"), (F.col("event_id") % 5).alias("rank"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    found = TR.detail(e.groupBy("trace_id").agg(F.min("ts").alias("started_at")), stages, h)
    show = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit(":"), x[b].cast("string"))), ",")
    return found.select("trace_id", show("events", "event_id", "stage").alias("events"), F.when(F.col("hits").isNotNull(), show("hits", "stage", "rank")).alias("hits"))


@query("stage_hits", BM25_SQL + " SELECT qid, doc_id AS id, CAST(rank AS INT) AS rank, 'bm25' AS stage, NULL AS reason FROM rk WHERE rank < 5 UNION ALL SELECT qid, doc_id, CAST(rank AS INT), 'cut', 'top_k_cutoff' FROM rk WHERE rank >= 3 AND rank < 5")
def stage_hits(spark, d):
    h = hits(spark, d, 5).select("qid", "id", "rank")
    return TR.stage_hits({"bm25": h, "cut": V.cutoff(h, 3)[1]}).select("qid", "id", "rank", "stage", "reason")


@query("run_manifest", "SELECT count(*) AS total, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS avg_length, CAST(min(length(text)) AS INT) AS min_length, CAST(max(length(text)) AS INT) AS max_length, (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT coalesce(nullif(lang, ''), 'unknown') AS v, count(*) AS n FROM documents GROUP BY 1)) AS types, (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT coalesce(nullif(source, ''), 'unknown') AS v, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS issuers FROM documents")
def run_manifest(spark, d):
    m = W.manifest(t(spark, d, "documents").select(F.col("text").alias("content"), F.col("lang").alias("doc_type"), F.col("source").alias("issuer")))
    pair = lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda x: pair(x["key"], x["value"])), ",")
    return m.select("total", "avg_length", "min_length", "max_length", types.alias("types"), F.array_join(F.transform("top_issuers", lambda x: pair(x["value"], x["n"])), ",").alias("issuers"))


@query("integrity_totals", "SELECT count(*) AS pages, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS done, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS missing FROM part")
def integrity_totals(spark, d):
    return C.integrity_totals(t(spark, d, "part"), t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("merged_order", "WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn FROM events) SELECT event_id, turn, row_number() OVER (PARTITION BY turn ORDER BY event_type) - 1 AS place FROM n")
def merged_order(spark, d):
    return C.interleave(t(spark, d, "events"), "event_type", "event_id").select("event_id", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("chunk_stats", PIECES_SQL + r""", w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM l WHERE doc_id % 5 = 0), n AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 682 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 682) / 640.0) AS INT) END AS c FROM w), x AS (SELECT doc_id, ws, unnest(range(0, c)) AS i FROM n),
r AS (SELECT doc_id, 1 AS s, len(regexp_extract_all(trim('Điều 1. ' || t1) || ' 1. ' || a || 'x a) ' || b || 'y', '\S+')) AS k FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 1, len(regexp_extract_all(trim('Điều 1. ' || t1) || ' 2. ' || b || 'z Chương II', '\S+')) FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 1, len(regexp_extract_all('Điều 2a. ' || b || 'w Nội dung ' || a || 'k', '\S+')) FROM l WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 0, len(ws[i * 640 + 1 : i * 640 + 682]) FROM x),
k AS (SELECT *, CAST(floor(k * 1.5) AS INT) AS n FROM r) SELECT count(DISTINCT CASE WHEN s = 1 THEN doc_id END) AS with_articles, count(DISTINCT CASE WHEN s = 0 THEN doc_id END) AS fallback, count(*) AS chunks, CAST(0 AS BIGINT) AS collisions, round_even(avg(n), 1) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM k""")
def chunk_stats(spark, d):
    return C.chunk_stats(L.chunks(law_docs(spark, d)))


RERANK_SQL = BM25_SQL + f""", qs AS (SELECT item_id AS qid, list_filter(regexp_extract_all(lower(replace(text, '_', ' ')), '{DUCK_WORD}'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')) AS ts FROM benchmark),
qp AS (SELECT qid, list_distinct(ts) AS ws, list_filter(list_distinct(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))), lambda x: length(x) >= 6) AS ps FROM qs),
h AS (SELECT rk.qid, doc_id, rank, score, ws, ps, regexp_extract_all(lower(replace('Luật ' || source || ' 2020 ' || text, '_', ' ')), '{DUCK_WORD}') AS hay, rk.qid % 3 > 0 AND rk.qid % 9 = doc_id % 9 AS m FROM rk JOIN documents USING (doc_id) JOIN qp ON qp.qid = rk.qid WHERE rank < 20),
x AS (SELECT qid, doc_id, rank, 0.001 * score + 0.0005 * len(list_intersect(ws, hay)) + 0.0015 * len(list_filter(ps, lambda p: contains(array_to_string(hay, ' '), p))) + CASE WHEN qid % 3 > 0 AND m THEN 0.004 WHEN qid % 3 > 0 THEN -0.0015 ELSE 0 END
+ CASE WHEN doc_id % 6 > 0 AND doc_id % 6 = qid % 6 THEN 0.006 WHEN m THEN -0.002 ELSE 0 END + CASE WHEN doc_id % 4 > 0 AND doc_id % 4 = qid % 4 THEN 0.004 WHEN m THEN -0.0015 ELSE 0 END AS s FROM h)"""


@query("heuristic_rerank", RERANK_SQL + " SELECT qid, doc_id AS id, round(s, 7) AS rerank_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, rank) - 1 AS INT) AS rank FROM x")
def heuristic_rerank(spark, d):
    """Token, phrase and reference hits of the whole texts themselves."""
    words = passages(spark, d).select("qid", F.array_distinct(T.tokens(F.col("query"), query=True)).alias("ws"), T.phrases(F.col("query"), 6).alias("ps"))
    rows = unit_rows(spark, d, 20).join(words, "qid").withColumn("hay", T.tokens(F.concat_ws(" ", "title", "text")))
    held = F.transform(F.array(F.array_join("hay", " ")), lambda hay: F.size(F.filter("ps", lambda p: F.contains(hay, p))))[0]  # joined once, not for each phrase
    is_unit = lambda value, word, ref: SE.unit_number(F.col(value), F.col("path"), word) == R.numeric_ref(F.col(f"refs.{ref}"))
    bonus = S.reference_bonus(SE.has_document(F.col("refs")), F.col("in_document"), is_unit("article", "dieu", "article_number"), is_unit("clause", "khoan", "clause_number"), F.lit(None).cast("boolean"))
    rows = rows.withColumns({"rrf_score": F.lit(0.0), "token_hits": F.size(F.array_intersect("ws", "hay")), "phrase_hits": held, "bonus": bonus})
    return S.heuristic_rerank(rows).select("qid", "id", F.round("rerank_score", 7).alias("rerank_score"), "rank")
