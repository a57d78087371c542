"""Heuristic scores of hits, documents and law families as column expressions over one joined frame.

Frames carry the hit's title, path, article, text, document_number, doc_type and
the query plan's arrays (concept_phrases, actor_terms, action_terms,
object_terms, anchors, doc_type_prior, role_prior).  All text is folded on both
sides, so that accents never decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.refs import document_number
from lexloom.operators.retrieval import rrf_rank_score

#: Fixed values of forms, places and kinds.
LEGAL_FORMS = r"\b(luat|bo\s+luat|nghi\s+dinh|thong\s+tu|vbhn|van\s+ban\s+hop\s+nhat)\b"
#: Words of pages that are no laws (fixed values).
GARBAGE = r"\b(dang nhap|dang ky|mat khau|tin tuc|lien he|trang chu|menu|login)\b"
LOCAL_PLACES = r"\b(ubnd|hdnd|tinh|thanh\s+pho|quan|huyen)\b"
WEAK_BUCKETS = ("cong_van", "quyet_dinh_ubnd", "van_ban_dia_phuong")
LEGAL_BUCKETS = ("luat", "bo_luat", "nghi_dinh", "vbhn", "thong_tu")
#: Titles that say what an office does and no more (fixed values).
GENERIC_TITLES = ("chuc nang nhiem vu quyen han", "co cau to chuc", "nhiem vu quyen han", "quy dinh chuc nang", "quy che lam viec")


def bucket(number: Column, doc_type: Column, title: Column, path: Column) -> Column:
    """Kind of document: the number decides, else the words, each in this order."""
    n = document_number(number)
    hay = T.folded_query(doc_type, title, path, number)
    has = n != ""
    return (
        F.when(has & (F.contains(n, F.lit("QD-UBND")) | F.contains(n, F.lit("QDHDND"))), "quyet_dinh_ubnd").when(has & F.contains(n, F.lit("NQ-HDND")), "van_ban_dia_phuong")
        .when(has & (F.contains(n, F.lit("CONG-VAN")) | n.startswith("CV")), "cong_van").when(has & F.contains(n, F.lit("VBHN")), "vbhn").when(has & F.contains(n, F.lit("ND-CP")), "nghi_dinh")
        .when(has & F.contains(n, F.lit("TT")) & F.contains(n, F.lit("-")), "thong_tu").when(has & n.rlike(r"/QH\d{1,2}$"), "luat").when(has & F.contains(n, F.lit("L-CTN")), "bo_luat")
        .when(hay.rlike(r"\bcong\s+van\b"), "cong_van").when(hay.rlike(r"\bquyet\s+dinh\b") & hay.rlike(LOCAL_PLACES), "quyet_dinh_ubnd")
        .when(hay.rlike(r"\bnghi\s+quyet\b") & hay.rlike(LOCAL_PLACES), "van_ban_dia_phuong").when(hay.rlike(r"\b(van\s+ban\s+hop\s+nhat|vbhn)\b"), "vbhn")
        .when(hay.rlike(r"\bnghi\s+dinh\b"), "nghi_dinh").when(hay.rlike(r"\bbo\s+luat\b"), "bo_luat").when(hay.rlike(r"\bluat\b"), "luat").when(hay.rlike(r"\bthong\s+tu\b"), "thong_tu").otherwise("")
    )


def local_admin(number: Column, doc_type: Column, title: Column, path: Column) -> Column:
    n, hay = document_number(number), T.folded_query(doc_type, title, path, number)
    by_number = n.rlike("QD-UBND|QDHDND|NQ-HDND") | (F.contains(n, F.lit("UBND")) & n.rlike("QD|NQ"))
    return by_number | (~hay.rlike(r"\b(luat|bo\s+luat|nghi\s+dinh|thong\s+tu)\b") & hay.rlike(r"\b(quyet\s+dinh|cong\s+van|thong\s+bao|chi\s+thi|ke\s+hoach|quy\s+che)\b"))


def preferred(kind: Column, title: Column, doc_type: Column, path: Column) -> Column:
    return kind.isin(*LEGAL_BUCKETS) | T.folded_query(title, doc_type, path).rlike(r"\b(quoc\s+hoi|chinh\s+phu|bo\s+truong|bo\s+tai\s+chinh|bo\s+noi\s+vu)\b")


def drafting(title: Column, doc_type: Column) -> Column:
    return T.folded_query(title, doc_type).rlike(r"\b(ban\s+hanh\s+van\s+ban\s+quy\s+pham|van\s+ban\s+quy\s+pham\s+phap\s+luat)\b")


def role(kind: Column, title: Column, path: Column) -> Column:
    sanction = T.folded_query(title, path).rlike(r"\b(xu phat|vi pham hanh chinh|ky luat)\b")
    return (
        F.when(kind.isin("luat", "bo_luat"), "law_core").when(kind == "vbhn", "consolidated").when(kind.isin("nghi_dinh", "thong_tu") & sanction, "implementation_sanction")
        .when(kind.isin("nghi_dinh", "thong_tu"), "implementation").when(kind.isin("quyet_dinh_ubnd", "van_ban_dia_phuong"), "local_admin").when(kind == "cong_van", "guidance").otherwise("unknown")
    )


def garbage_family(key: Column) -> Column:
    k = T.folded_query(key)
    return (k == "") | k.rlike(GARBAGE)


def legal_family(key: Column) -> Column:
    return ~garbage_family(key) & T.folded_query(key).rlike(LEGAL_FORMS)


def _sum_if(items: Column, each) -> Column:
    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")), F.lit(0.0), lambda s, p: s + F.when(p != "", each(p)).otherwise(0.0))


def _any_in(items: Column, hay: Column) -> Column:
    return F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda p: (p != "") & F.contains(hay, p))


def concept_coverage(phrases: Column, title: Column, path: Column, article: Column, body: Column) -> Column:
    head, text = T.folded_query(title, path, article), T.folded_query(F.substring(body, 1, 1200))
    return F.least(F.lit(2.0), _sum_if(phrases, lambda p: F.when(F.contains(head, p), 1.0).when(F.contains(text, p), 0.5).otherwise(0.0)))


def actor_action(actors: Column, actions: Column, objects: Column, *parts: Column) -> Column:
    hay = T.folded_query(*parts)
    a, b, c = _any_in(actors, hay), _any_in(actions, hay), _any_in(objects, hay)
    return F.least(F.lit(1.5), F.when(a, 0.5).otherwise(0.0) + F.when(b, 0.5).otherwise(0.0) + F.when(c, 0.3).otherwise(0.0) + F.when(a & b, 0.4).otherwise(0.0))


def title_anchor(anchors: Column, phrases: Column, title: Column, path: Column, number: Column) -> Column:
    hay = T.folded_query(title, path, number)
    return F.least(F.lit(2.0), _sum_if(anchors, lambda p: F.when(F.contains(hay, p), 0.8).otherwise(0.0)) + _sum_if(phrases, lambda p: F.when(F.contains(hay, p), 0.7).otherwise(0.0)))


def type_prior(prior: Column, kind: Column) -> Column:
    at = F.array_position(F.coalesce(prior, F.array().cast("array<string>")), kind)
    return F.when(at > 0, F.greatest(F.lit(0.0), 1.0 - (at - 1) * 0.2)).otherwise(0.0)


def role_prior(prior: Column, found: Column) -> tuple[Column, Column]:
    """Score and penalty of a role against the expected ones."""
    at = F.array_position(prior, found)
    score = F.when(at > 0, F.greatest(F.lit(0.0), 1.0 - (at - 1) * 0.22)).otherwise(0.0)
    lost = F.when((F.size(prior) == 0) | (at > 0), 0.0).when(found.isin("local_admin", "guidance"), 0.7).when(found == "unknown", 0.25).otherwise(0.35)
    return score, lost


def genericity(title: Column, anchor: Column, concept: Column, actor_action_: Column) -> Column:
    """Penalty of a title that says what an office does, more for every score that does not speak for it."""
    hay = T.folded_query(title)
    marked = hay.rlike("|".join(GENERIC_TITLES))
    lost = F.when(anchor < 0.6, 0.5).otherwise(0.0) + F.when(concept < 0.7, 0.4).otherwise(0.0) + F.when(actor_action_ < 0.6, 0.3).otherwise(0.0)
    return F.when(marked, F.least(F.lit(1.0), lost)).otherwise(0.0)


def family_identity(key: Column, number: Column, doc_type: Column, title: Column, path: Column) -> Column:
    head = T.folded_query(title, path, number, doc_type)
    kind = bucket(number, doc_type, title, path)
    s = F.when(legal_family(key), 0.95).when(head.rlike(r"\b(nghi\s+dinh|thong\s+tu|vbhn|van\s+ban\s+hop\s+nhat)\b"), 0.65).otherwise(-0.45)
    s = s - F.when(local_admin(number, doc_type, title, path), 0.75).otherwise(0.0) - F.when(kind.isin(*WEAK_BUCKETS), 0.60).otherwise(0.0)
    s = s - F.when(garbage_family(key) | garbage_family(head), 1.20).otherwise(0.0) - F.when(T.word_count(head) <= 3, 0.15).otherwise(0.0)
    return F.greatest(F.lit(-2.0), F.least(F.lit(1.8), s))


#: Weights of a candidate document's score by component (fixed values).
DOC_WEIGHTS = {"type_prior": 0.18, "role_prior": 0.20, "title_anchor": 0.28, "identity": 0.55, "wrong_role": -0.55, "genericity": -0.50}
RANK_WEIGHTS = {"core": 1.00, "expanded": 0.85, "title": 1.10, "vector": 0.55}


def candidate_documents(hits: DataFrame) -> DataFrame:
    """Hits (qid, doc_id, pass, rank from 1, components) to one row per document: least rank per pass, its sample row and score."""
    order = {"core": 0, "expanded": 1, "title": 2, "vector": 3}
    later = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col("pass")]
    parts = ("concept", "actor_action", *DOC_WEIGHTS)
    ranks = [F.min(F.when(F.col("pass") == p, F.col("rank"))).alias(f"{p}_rank") for p in RANK_WEIGHTS]
    sample = F.max_by(F.struct("family", "role", *parts), F.struct(later, -F.col("rank"))).alias("s")
    docs = hits.groupBy("qid", "doc_id").agg(*ranks, F.count_distinct("pass").alias("sources"), F.collect_set("pass").alias("passes"), sample)
    score = sum((w * rrf_rank_score(F.col(f"{p}_rank")) for p, w in RANK_WEIGHTS.items()), F.lit(0.0)) + 0.80 * (0.62 * F.col("s.concept") + 0.38 * F.col("s.actor_action"))
    score = score + sum((w * F.col(f"s.{p}") for p, w in DOC_WEIGHTS.items()), F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("s.title_anchor"), "doc_id")
    return docs.withColumn("score", score).withColumn("rank", F.row_number().over(w))


FAMILY_WEIGHTS = {"identity": 0.95, "concept": 0.62, "bm25": 0.52, "title": 0.34, "vector": 0.22, "genericity": -0.35, "wrong_role": -0.30}


def families(docs: DataFrame, margin_floor: float = 0.10, garbage_margin: float = 0.08) -> DataFrame:
    """Candidate documents to law families: mean components, two-phase score, rejection, trust and confidence of the best."""
    bm25 = rrf_rank_score(F.least("core_rank", "expanded_rank")) * 60
    per = docs.groupBy("qid", F.col("s.family").alias("family")).agg(
        F.avg("s.identity").alias("identity"), F.avg("s.concept").alias("concept"), F.avg(bm25).alias("bm25"), F.avg(rrf_rank_score(F.col("title_rank")) * 60).alias("title"),
        F.avg(rrf_rank_score(F.col("vector_rank")) * 60).alias("vector"), F.avg("s.genericity").alias("genericity"), F.avg("s.wrong_role").alias("wrong_role"),
        F.avg("s.role_prior").alias("prior"), F.size(F.array_distinct(F.flatten(F.collect_list("passes")))).alias("agreement"), F.max_by("s.role", F.struct("score", "doc_id")).alias("top_role"), F.count(F.lit(1)).alias("documents"),
    )
    base = sum((w * F.col(c) for c, w in FAMILY_WEIGHTS.items()), F.lit(0.0))
    by_base = Window.partitionBy("qid").orderBy(F.desc("base"), "family")
    every = Window.partitionBy("qid")
    per = per.withColumn("base", base).withColumn("n", F.row_number().over(by_base))
    per = per.withColumn("b1", F.max(F.when(F.col("n") == 1, F.col("base"))).over(every)).withColumn("b2", F.coalesce(F.max(F.when(F.col("n") == 2, F.col("base"))).over(every), F.lit(0.0)))
    low = (F.col("b1") < 0.85) | (F.col("b1") - F.col("b2") < margin_floor)
    per = per.withColumn("score", F.col("base") + F.when(low, 0.30).otherwise(1.0) * 0.40 * F.col("prior"))
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "family")
    per = per.withColumn("rank", F.row_number().over(by_score)).withColumn("next", F.coalesce(F.lead("score").over(by_score), F.lit(0.0))).withColumn("margin", F.col("score") - F.col("next"))
    legal, near = legal_family(F.col("family")), F.col("margin") < garbage_margin
    per = per.withColumn("legal", legal).withColumn("rejected", (F.col("rank") == 1) & (garbage_family(F.col("family")) | near | (F.col("agreement") < 2)))
    trusted = (F.col("rank") == 1) & ~F.col("rejected") & F.col("legal") & (F.col("agreement") >= 2) & ((F.col("margin") >= 0.10) | (F.col("score") >= 1.0)) & ~((F.col("top_role") == "unknown") & (F.col("margin") < 0.14))
    return per.withColumn("trusted", trusted).withColumn("confidence", F.col("score") + F.least(F.lit(0.40), F.col("margin")) + 0.10 * F.greatest(F.lit(0), F.col("agreement") - 1)).drop("n", "b1", "b2", "next")


def document_gate(hits: DataFrame, hard: bool = False, keep: int = 3) -> DataFrame:
    """Rows (qid, id, rank, kind, local, preferred, allow, exclude, prior) that the document-type gate keeps."""
    allow, exclude, prior = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("allow", "exclude", "prior"))
    out = (F.lit(hard) & (~F.array_contains(allow, F.col("kind")) | F.col("kind").isin(*WEAK_BUCKETS))) | F.array_contains(exclude, F.col("kind")) | (F.col("local") & ~F.col("preferred"))
    every = Window.partitionBy("qid")
    g = hits.withColumn("pass1", ~out).withColumn("kept1", F.count_if("pass1").over(every))
    pref = Window.partitionBy("qid").orderBy(F.desc(F.col("preferred").cast("int")), "rank")
    plain = Window.partitionBy("qid").orderBy("rank")
    n_pref = F.count_if("preferred").over(every)
    fallback = F.lit(not hard) & (F.col("kept1") == 0) & F.when(n_pref > 0, F.col("preferred") & (F.row_number().over(pref) <= max(keep, 5))).otherwise(F.row_number().over(plain) <= 3)
    g = g.withColumn("pass2", F.col("pass1") | fallback).withColumn("good", F.col("pass2") & (F.array_contains(prior, F.col("kind")) | F.col("preferred")))
    n_good = F.count_if("good").over(every)
    narrow = (F.size(prior) > 0) & F.when(F.lit(hard), n_good > 0).otherwise(n_good >= keep)
    return g.withColumn("narrow", narrow).filter(F.when(F.col("narrow"), F.col("good")).otherwise(F.col("pass2"))).drop("pass1", "kept1", "pass2", "good", "narrow")


def heuristic_rerank(hits: DataFrame) -> DataFrame:
    """Rows (qid, id, rank, rrf_score, score, token_hits, phrase_hits, bonus) by base plus hit and route bonuses; ties keep the old rank."""
    base = F.when(F.coalesce(F.col("rrf_score"), F.lit(0.0)) > 0, F.col("rrf_score")).otherwise(0.001 * F.col("score"))
    out = hits.withColumn("rerank_score", base + 0.0005 * F.col("token_hits") + 0.0015 * F.col("phrase_hits") + F.col("bonus")).withColumnRenamed("rank", "original_rank")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("rerank_score", 12)), "original_rank")
    return out.withColumn("rank", F.row_number().over(w) - 1)


def reference_bonus(doc_wanted: Column, doc_match: Column, article: Column, clause: Column, chapter: Column) -> Column:
    """Route bonus of references: each of article, clause and chapter is true, false or null (not asked)."""

    def part(x: Column, plus: float, minus: float) -> Column:
        return F.when(x, plus).when(~x & doc_match, -minus).otherwise(0.0)

    return F.when(doc_wanted & doc_match, 0.004).when(doc_wanted, -0.0015).otherwise(0.0) + part(article, 0.006, 0.002) + part(clause, 0.004, 0.0015) + part(chapter, 0.003, 0.001)


def focus_targets(hits: DataFrame, key: str = "doc_id", window: int = 12) -> DataFrame:
    """Up to two keys per query, in order of appearance, that stand at least twice in the window, first among its first three."""
    per = hits.filter(F.col("rank") < window).groupBy("qid", key).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy("qid").orderBy("first_rank", key)
    return per.filter("n >= 2 AND first_rank <= 2").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").drop("rn")


def law_order(hits: DataFrame) -> DataFrame:
    """Anchored hits first, then by score and old rank; without any anchored hit the order stays."""
    w = Window.partitionBy("qid").orderBy(F.desc("priority"), F.desc("score"), "rank")
    guard = F.max("priority").over(Window.partitionBy("qid")) > 0
    return hits.withColumn("new_rank", F.when(guard, F.row_number().over(w) - 1).otherwise(F.col("rank")))


def implementation_bridge(candidates: DataFrame, trusted: DataFrame, docs: int, min_margin: float = 0.10) -> DataFrame:
    """Selected documents and up to two more of an implementing role, in candidate order, for trusted families of enough margin."""
    w = Window.partitionBy("qid").orderBy("rank")
    more = candidates.filter(F.col("s.role").isin("implementation", "implementation_sanction", "consolidated") & (F.col("rank") > docs)).join(trusted.filter(F.col("trusted") & (F.col("margin") >= min_margin)).select("qid").distinct(), "qid")
    more = more.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("qid", "doc_id", "rank")
    return candidates.filter(F.col("rank") <= docs).select("qid", "doc_id", "rank").unionByName(more)
