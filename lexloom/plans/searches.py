"""Registered queries of the routed search over questions that the given tables fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import concept as CO
from lexloom.operators import retrieval as V
from lexloom.operators import rewrite as Q
from lexloom.operators import routed
from lexloom.plans.catalog import BM25_SQL, hits, index_of, passages, t, texts, units
from lexloom.plans.registry import query
from lexloom.sources.shared import cut


def _named(spark, d):
    """(id, name): a law's name from the first words of a document, none of which ends a name in a question."""
    words = F.filter(T.ascii_tokens(F.col("text")), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin("quy"))
    return texts(spark, d).select(F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 4), " ").alias("name"))


def questions(spark, d, named):
    """(qid, query): the passages behind a decree's clause, a decree's number, a law's name, or nothing."""
    q = F.col("qid")
    number = F.concat((q % 9 + 1).cast("string"), F.lit("/2024/NĐ-CP "))
    exact = F.concat(F.lit("Khoản 1 Điều "), (q % 6).cast("string"), F.lit(" Nghị định "), number)
    rows = passages(spark, d).join(named.withColumnRenamed("id", "law"), F.col("law") == q * 5, "left")
    law = F.concat(F.lit("Luật "), F.coalesce("name", F.lit("")), F.lit(" quy định thế nào về "))
    head = F.when(q % 4 == 0, exact).when(q % 4 == 1, number).when((q % 4 == 2) & (F.size(F.split("name", " ")) == 4), law).otherwise("")
    return rows.select("qid", F.concat(head, "query").alias("query"))


def searched(spark, d):
    named = cut(_named(spark, d), "routed-names")  # names come from whole texts: every stage reads them, none works them out again
    chunks = cut(units(spark, d).drop("title").join(named, "id").withColumn("title", F.concat(F.lit("Luật "), "name")).drop("name"), "routed-chunks")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))

    def vector(asks, k):
        """Vectors of the passages' numbers; more are asked for where a scope cuts them."""
        mine = asks.join(vectors.withColumnRenamed("id", "qid"), "qid").select("qid", F.col("v").alias("qv"), "allowed")
        free = V.vector_search(vectors, mine.filter("size(allowed) = 0").select("qid", "qv"), k)
        scope = mine.select("qid", "qv", F.explode("allowed").alias("doc_id")).join(chunks.select("id", "doc_id"), "doc_id").join(vectors, "id")
        unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        inside = V.top_k(scope.select("qid", "id", F.coalesce(dot / F.nullif(unit(F.col("qv")) * unit(F.col("v")), F.lit(0.0)), F.lit(0.0)).alias("score")), k)
        return free.unionByName(inside)

    return routed.search(index_of(spark, d), questions(spark, d, named), chunks, chunks.select("doc_id", "title"), vector)


ROUTES_SQL = r"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(lower(translate(strip_accents(text), 'đĐ', 'dD')), '[a-z0-9]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$') AND w <> 'quy')[1:4] AS ws FROM documents),
q AS (SELECT item_id AS qid, CASE WHEN item_id % 4 = 2 AND coalesce(len(ws), 0) < 4 THEN 3 ELSE item_id % 4 END AS form, list_distinct(['luat'] || ws) AS ws FROM benchmark LEFT JOIN n ON doc_id = item_id * 5),
w AS (SELECT qid, len(ws) AS n, unnest(ws) AS w FROM q WHERE form = 2), tw AS (SELECT doc_id, len(list_distinct(['luat'] || ws)) AS size, unnest(list_distinct(['luat'] || ws)) AS w FROM n),
s AS (SELECT qid, CAST(doc_id AS VARCHAR) AS doc_id, count(*) / any_value(n) AS c, any_value(size) AS size FROM w JOIN tw USING (w) GROUP BY qid, tw.doc_id HAVING count(*) / any_value(n) >= 0.65),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, size, doc_id) AS k FROM s),
l AS (SELECT qid, count(*) AS many, max(c) FILTER (k = 1) AS c1, coalesce(max(c) FILTER (k = 2), 0) AS c2, list(doc_id ORDER BY k) AS ids FROM r WHERE k <= 5 GROUP BY qid),
x AS (SELECT *, CASE WHEN many = 1 THEN 1 WHEN c1 - c2 > 0.01 AND round(c1 - c2, 9) >= 0.05 AND c1 >= 0.9 THEN 1 WHEN c1 - c2 > 0.01 AND round(c1 - c2, 9) >= 0.02 AND c1 >= 0.84 THEN 2 ELSE 3 END AS keep FROM l),
u AS (SELECT item_id AS qid, least(count(doc_id), 20) AS hits FROM benchmark LEFT JOIN documents ON doc_id % 9 = item_id % 9 AND doc_id % 6 = item_id % 6 AND item_id % 6 > 0 AND item_id % 4 = 0 GROUP BY 1)
SELECT qid, ['structured_exact', 'narrow_bm25', 'law_anchored_hybrid', 'hybrid_default'][form + 1] AS initial_route,
CASE form WHEN 0 THEN CASE WHEN hits > 0 THEN 'structured_exact' ELSE 'narrow_bm25' END WHEN 1 THEN 'narrow_bm25' WHEN 2 THEN CASE WHEN many = 1 THEN 'exact_doc' ELSE 'candidate_docs' END ELSE 'hybrid_default' END AS route,
CASE WHEN form = 2 THEN array_to_string(ids[1:keep], ',') ELSE '' END AS allowed, hits AS n_structured, CASE form WHEN 0 THEN CASE WHEN hits > 0 THEN 'structured_lookup' ELSE 'route' END WHEN 1 THEN 'route' END AS skipped FROM q JOIN u USING (qid) LEFT JOIN x USING (qid)"""


@query("routed_decisions", ROUTES_SQL)
def routed_decisions(spark, d):
    """Routes, scopes and structured hits of every question; what skipped its vectors, where the route alone decides."""
    skipped = F.when(F.col("vector_skipped").isin("structured_lookup", "route"), F.col("vector_skipped"))
    return searched(spark, d)[1].select("qid", "initial_route", "route", F.array_join("allowed", ",").alias("allowed"), "n_structured", skipped.alias("skipped"))


@query("routed_search")
def routed_search(spark, d):
    """All stages of every question; tests hold them against plain Python."""
    return searched(spark, d)[0]


#: Concept phrases behind which a question asks its passage; every sixth asks nothing of the kind.
TOLD = ["Thẩm quyền xử phạt vi phạm hành chính", "Điều kiện tuyển dụng công chức", "", "Hiệu lực thi hành", "Đơn phương chấm dứt hợp đồng lao động", "Trách nhiệm của cán bộ"]


def concept_questions(spark, d):
    head = F.element_at(F.array(*map(F.lit, TOLD)), (F.col("qid") % len(TOLD) + 1).cast("int"))
    return Q.rewrite(passages(spark, d).select("qid", F.trim(F.concat(head, F.lit(" "), "query")).alias("query"))).withColumn("focus_terms", F.array().cast("array<string>"))


@query("concept_rounds")
def concept_rounds(spark, d):
    """What every concept question decides in its two rounds; tests hold the rounds against plain Python."""
    ix = index_of(spark, d)
    return CO.rounds(ix, concept_questions(spark, d), units(spark, d))[3]


FEATURE_SQL = BM25_SQL + f""", q AS (SELECT item_id AS qid, [['thanh tra', 'cong chuc'], ['cong chuc'], [], ['lao dong']][item_id % 4 + 1] AS actors, [['xu phat'], [], ['tuyen dung'], ['cham dut']][item_id % 4 + 1] AS actions, [['tham quyen xu phat', 'xu phat vi pham hanh chinh', 'nguoi co tham quyen', 'quyet dinh xu phat'], ['dieu kien tuyen dung', 'tieu chuan tuyen dung'], [], ['trach nhiem', 'co trach nhiem', 'chiu trach nhiem']][item_id % 4 + 1] AS phrases FROM benchmark),
d AS (SELECT doc_id, ['tham quyen xu phat cua thanh tra', 'dieu kien tuyen dung cong chuc', 'nguoi co tham quyen', 'co trach nhiem', ''][doc_id % 5 + 1] AS said, CASE WHEN doc_id % 7 = 0 THEN 'luat tieu chuan tuyen dung' WHEN doc_id % 7 = 1 THEN 'nghi dinh xu phat vi pham hanh chinh' ELSE 'luat so ' || (doc_id % 7) END AS title FROM documents)
SELECT qid, doc_id AS id, least(2.0, list_sum([0.0] || [CASE WHEN contains(title, p) THEN 1.0 WHEN contains(said, p) THEN 0.5 ELSE 0.0 END FOR p IN phrases])) AS concept, least(2.0, list_sum([0.0] || [CASE WHEN contains(title, p) THEN 0.7 ELSE 0.0 END FOR p IN phrases])) AS title_anchor,
least(1.5, (CASE WHEN a THEN 0.5 ELSE 0 END) + (CASE WHEN b THEN 0.5 ELSE 0 END) + (CASE WHEN a AND b THEN 0.4 ELSE 0 END)) AS actor_action, CASE WHEN doc_id % 7 = 1 THEN 'implementation_sanction' ELSE 'law_core' END AS role
FROM (SELECT rk.qid, rk.doc_id, said, title, phrases, len(list_filter(actors, lambda x: contains(title || ' ' || said, x))) > 0 AS a, len(list_filter(actions, lambda x: contains(title || ' ' || said, x))) > 0 AS b FROM rk JOIN q USING (qid) JOIN d USING (doc_id) WHERE rank < 20)"""


@query("item_features", FEATURE_SQL)
def item_features(spark, d):
    """Scores of found documents, whose titles and first words speak of concepts, for plans that ask for them."""
    i, q = F.col("doc_id"), F.col("qid")
    pick = lambda items, at: F.element_at(F.array(*items), (at % len(items) + 1).cast("int"))
    words = lambda *lists: [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in lists]
    said = pick(list(map(F.lit, ("Thẩm quyền xử phạt của thanh tra", "Điều kiện tuyển dụng công chức", "người có thẩm quyền", "có trách nhiệm", ""))), i)
    title = F.when(i % 7 == 0, "Luật Tiêu chuẩn tuyển dụng").when(i % 7 == 1, "Nghị định xử phạt vi phạm hành chính").otherwise(F.concat(F.lit("Luật số "), (i % 7).cast("string")))
    chunks = t(spark, d, "documents").select(i.alias("id"), i.cast("string").alias("doc_id"), title.alias("title"), *(F.lit("").alias(c) for c in ("path", "article", "document_number")), said.alias("text"))
    plan = passages(spark, d).select(
        "qid", pick(words(["tham_quyen_xu_phat"], ["dieu_kien_tuyen_dung"], [], ["trach_nhiem"]), q).alias("concept_tags"), pick(words(["thanh tra", "cong chuc"], ["cong chuc"], [], ["lao dong"]), q).alias("actor_terms"),
        pick(words(["xu phat"], [], ["tuyen dung"], ["cham dut"]), q).alias("action_terms"), *(F.array().cast("array<string>").alias(c) for c in ("object_terms", "legal_anchor_guess", "doc_type_prior")), F.lit("labor").alias("topic_class"),
    )
    return CO.features(hits(spark, d, 20), plan, chunks).select("qid", "id", "concept", F.round("title_anchor", 6).alias("title_anchor"), F.round("actor_action", 6).alias("actor_action"), "role")
