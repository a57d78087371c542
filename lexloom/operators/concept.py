"""Recall of concept queries in rounds: passes, item features, families, and a second round where the first is unsure.

Round one searches the core, expanded and title texts of all plans at once and
scores every hit by what its text says of the plan.  Queries whose families do
not lead, or whose title found nothing, search again by their concept's words;
queries whose gate opens take vector hits.  Both are one batched search over
those that need it.  Limits, thresholds and tables are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import index as IX
from lexloom.operators import retrieval as V
from lexloom.operators import rewrite as Q
from lexloom.operators import routed
from lexloom.operators import scoring as S
from lexloom.operators import search as SE
from lexloom.sources.shared import cut

#: Phrases that speak for a concept in a hit; a phrase of two tags counts for each (fixed values).
ITEM_PHRASES = {
    "pham_vi_dieu_chinh": ["pham vi dieu chinh", "doi tuong ap dung", "ap dung doi voi"], "doi_tuong_ap_dung": ["doi tuong ap dung", "pham vi ap dung", "ap dung doi voi"],
    "hieu_luc_thi_hanh": ["hieu luc thi hanh", "co hieu luc", "ngay co hieu luc"], "trach_nhiem": ["trach nhiem", "co trach nhiem", "chiu trach nhiem"],
    "nhiem_vu_quyen_han": ["nhiem vu quyen han", "quyen va nghia vu"], "quyen_va_nghia_vu": ["quyen va nghia vu", "nghia vu cua", "quyen cua"],
    "tham_quyen_xu_phat": ["tham quyen xu phat", "xu phat vi pham hanh chinh", "nguoi co tham quyen", "quyet dinh xu phat"], "xu_ly_ky_luat": ["xu ly ky luat", "hinh thuc ky luat"],
    "dieu_kien_tuyen_dung": ["dieu kien tuyen dung", "tieu chuan tuyen dung"], "don_phuong_cham_dut_hop_dong": ["don phuong cham dut hop dong", "thoi han bao truoc"],
    "trinh_tu_thu_tuc": ["trinh tu thu tuc", "ho so thu tuc"], "thoi_han_giai_quyet": ["thoi han giai quyet", "thoi han xu ly"],
}
#: Roles of documents that a concept, or else a topic, expects, best first (fixed values).
CONCEPT_ROLES = {
    "pham_vi_dieu_chinh": ["law_core", "consolidated", "implementation", "implementation_sanction"], "dieu_kien_tuyen_dung": ["implementation", "consolidated", "law_core"], "xu_ly_ky_luat": ["implementation", "consolidated", "law_core"],
    "tham_quyen_xu_phat": ["implementation_sanction", "implementation", "consolidated", "law_core"], "don_phuong_cham_dut_hop_dong": ["law_core", "implementation", "consolidated"],
    "quyen_va_nghia_vu": ["law_core", "consolidated", "implementation"], "nhiem_vu_quyen_han": ["law_core", "implementation", "consolidated"], "hieu_luc_thi_hanh": ["consolidated", "law_core", "implementation"],
}
TOPIC_ROLES = {
    "labor": ["law_core", "implementation", "consolidated"], "civil_service": ["implementation", "law_core", "consolidated"], "administrative_sanction": ["implementation_sanction", "implementation", "consolidated", "law_core"],
    "social_insurance": ["implementation", "consolidated", "law_core"], "banking": ["law_core", "implementation", "consolidated"], "general_legal": ["law_core", "consolidated", "implementation"],
}
#: Merged hits after the expanded, title and recovery passes; hits of a recovery pass; margin below which families do not lead (fixed values).
LIMITS, RECOVERY_HITS, ABORT_HITS, LEAD = (72, 96, 128), 16, 12, 0.12
PLAN = ("concept_tags", "actor_terms", "action_terms", "object_terms", "legal_anchor_guess", "doc_type_prior", "topic_class")


def expected_roles(tags: Column, topic: Column) -> Column:
    lookup = F.create_map(*[x for k, v in TOPIC_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.array_distinct(Q._of(tags, CONCEPT_ROLES))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(F.try_element_at(lookup, topic), F.array(*map(F.lit, TOPIC_ROLES["general_legal"]))))


def features(hits: DataFrame, plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (qid, id, ...) with doc_id, family, role and the scores of their texts for the query's plan.

    ``chunks`` holds (id, doc_id, title, path, article, document_number, text).
    A phrase is looked for in the texts of the hits only, never in the corpus.
    """
    c = F.col
    known = chunks.select("id", "doc_id", "title", "path", "article", "document_number", "text")
    rows = hits.join(known, "id").join(plans.select("qid", *PLAN), "qid").withColumn("_phrases", Q._of("concept_tags", ITEM_PHRASES))
    kind, none = S.bucket(c("document_number"), F.lit(""), c("title"), c("path")), F.lit("")
    rows = rows.withColumns({
        "family": F.coalesce(F.nullif(T.family_key(c("title")), none), c("doc_id").cast("string")), "_kind": kind, "role": S.role(kind, c("title"), c("path")),
        "concept": S.concept_coverage(c("_phrases"), c("title"), c("path"), c("article"), c("text")),
        "actor_action": S.actor_action(c("actor_terms"), c("action_terms"), c("object_terms"), c("title"), c("path"), c("article"), F.substring("text", 1, 1200)),
        "title_anchor": S.title_anchor(c("legal_anchor_guess"), c("_phrases"), c("title"), c("path"), c("document_number")),
    })
    prior, lost = S.role_prior(expected_roles("concept_tags", c("topic_class")), c("role"))
    rows = rows.withColumns({
        "type_prior": S.type_prior(c("doc_type_prior"), c("_kind")), "role_prior": prior, "wrong_role": lost, "identity": S.family_identity(c("family"), c("document_number"), none, c("title"), c("path")),
        "genericity": S.genericity(c("title"), c("title_anchor"), c("concept"), c("actor_action")),
    })
    return rows.drop("title", "path", "article", "document_number", "text", "_phrases", "_kind", *PLAN)


def _text(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))


def rounds(index: IX.Index, plans: DataFrame, chunks: DataFrame, vector: Callable[[DataFrame, int], DataFrame] | None = None, vector_k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hits, documents, families, decisions) of rewritten queries.

    ``hits`` is (qid, id, score, rank, passes); ``vector`` takes (qid, allowed) and a number, as in the routed search.
    """
    plans = cut(plans.withColumns({
        "abort": routed.abort(), "recoverable": SE.recoverable(F.col("lexical_core"), F.col("concept_tags"), F.col("actor_terms"), F.col("action_terms"), F.col("object_terms"), F.col("title_anchor"), routed.abort()),
    }), "concept-plans")
    is_concept = F.size("concept_tags") > 0
    core, expanded = _text("concept_seed", "lexical_core", "clean", "query"), F.when(F.col("abort"), "").otherwise(_text("lexical_expanded", "clean", "query"))
    title = F.when(~F.col("abort") & (is_concept | F.col("recoverable")), _text("title_anchor")).otherwise("")
    each = F.array(*(F.struct(F.lit(n).alias("pass"), q.alias("query")) for n, q in (("core", core), ("expanded", expanded), ("title", title))))
    asked = plans.select("qid", "abort", F.explode(F.filter(each, lambda p: p["query"] != "")).alias("p")).select("qid", "abort", "p.*")
    first = SE.pass_hits(index, asked.drop("abort")).join(plans.select("qid", "abort"), "qid").filter(~F.col("abort") | (F.col("rank") < ABORT_HITS)).drop("abort")
    first = cut(features(first, plans, chunks), "concept-first")
    docs, best = _resolved(first)
    count = lambda p: F.count(F.when(F.col("pass") == p, 1))
    found = first.groupBy("qid").agg(count("core").alias("core_hits"), count("expanded").alias("expanded_hits"), count("title").alias("title_hits"))
    state = plans.join(found, "qid", "left").join(best, "qid", "left").na.fill(0, ["core_hits", "expanded_hits", "title_hits", "families", "margin"])
    unsure = (F.col("families") == 0) | (F.col("margin") < LEAD) | (F.col("title_hits") == 0)
    state = state.withColumn("recovery", unsure & ~F.col("abort") & F.col("recoverable"))
    gate = SE.vector_gate(F.col("concept_confidence"), F.col("vagueness_flags"), F.col("topic_class"), F.col("title_hits"), F.col("core_hits"), F.col("expanded_hits"), F.col("families"), F.col("margin"), F.col("abort"))
    state = cut(state.withColumn("vector", gate), "concept-state")
    # Round two: recovery hits count as title hits; vectors are a pass of their own.
    again = state.filter("recovery").select("qid", F.lit("recovery").alias("pass"), _text("concept_seed", "title_anchor", "clean", "query").alias("query"))
    more = cut(SE.pass_hits(index, again), "concept-recovery")
    title_hits = first.filter("pass = 'title'").select("qid", "id", "score", "rank")
    merged_title = V.merge_hits(title_hits.join(again.select("qid"), "qid", "left_semi"), more.select("qid", "id", "score", "rank"), limit=20).select("qid", F.lit("title").alias("pass"), "id", "score", "rank")
    passes = first.select("qid", "pass", "id", "score", "rank")
    kept = passes.join(again.select("qid"), "qid", "left_anti").unionByName(passes.join(again.select("qid"), "qid", "left_semi").filter("pass <> 'title'")).unionByName(merged_title)
    if vector is not None:
        near = vector(state.filter("vector").select("qid", F.array().cast("array<string>").alias("allowed")), vector_k)
        kept = kept.unionByName(near.select("qid", F.lit("vector").alias("pass"), "id", "score", "rank"))
    kept = cut(kept, "concept-passes")
    docs, best = _resolved(features(kept, plans, chunks))
    part = lambda p: kept.filter(F.col("pass") == p).select("qid", "id", "score", "rank")
    merged = V.merge_hits(V.merge_hits(part("core"), part("expanded"), limit=LIMITS[0]), title_hits, limit=LIMITS[1])
    merged = V.merge_hits(merged, more.select("qid", "id", "score", "rank"), limit=LIMITS[2])
    names = passes.unionByName(more.select("qid", "pass", "id", "score", "rank")).groupBy("qid", "id").agg(F.array_sort(F.collect_set("pass")).alias("passes"))  # four names at most
    mode = F.when(F.col("recovery"), "vague_concept_recovery").when(is_concept & ~F.col("abort"), "concept_aware").when(F.col("recoverable"), "vague_concept_recovery").otherwise("concept_aware_low_confidence")
    decisions = state.select("qid", mode.alias("mode"), "abort", "recoverable", "core_hits", "expanded_hits", "title_hits", "families", F.col("margin").alias("first_margin"), "recovery", "vector").join(
        best.select("qid", F.col("families").alias("last_families"), F.col("margin").alias("last_margin"), F.col("family"), F.col("trusted")), "qid", "left")
    return merged.join(names, ["qid", "id"]).select("qid", "id", "score", "rank", "passes"), docs, S.families(docs), decisions


def _resolved(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate documents of hits with features, and (qid, families, margin, family, trusted) of the best family."""
    docs = cut(S.candidate_documents(hits.withColumn("rank", F.col("rank") + 1)), "concept-docs")
    ranked = S.families(docs)
    n = Window.partitionBy("qid")
    best = ranked.withColumn("families", F.sum(F.when(F.col("rejected"), 0).otherwise(1)).over(n)).filter("rank = 1").select("qid", F.col("families").cast("int").alias("families"), "margin", "family", "trusted")
    return docs, best
