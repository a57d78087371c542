"""Routed search of a batch: every query takes the stages that its route and its hits ask for.

Nothing runs query by query.  Queries split by route; each stage is one search
over the queries that need it; what a stage finds decides, as columns, which
queries go to the next one; and the parts meet again before fusion:

    structured lookup -> BM25, scoped or free -> document gate -> vectors, unless a gate skips them
    -> scope fallback, exact retry (second searches) -> fusion -> dedup -> rerank -> focus -> cut

:func:`search` returns (qid, stage, id, rank, score, kept, filter_reason) and
one row of decisions for each query.  Limits and thresholds are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.functions import text as T
from lexloom.operators import index as IX
from lexloom.operators import retrieval as V
from lexloom.operators import rewrite as Q
from lexloom.operators import routing as RT
from lexloom.operators import scoring as S
from lexloom.operators import search as SE
from lexloom.sources.shared import cut

#: Least BM25 hits of the default route, and the most of BM25 and vectors for a search scoped to candidates (fixed values).
DEFAULT_HITS, CANDIDATE_HITS, CANDIDATE_VECTORS, FALLBACK_HITS = 60, 10, 8, 10
HARD_TOPICS = ("civil_service", "labor", "administrative_sanction")
NONE = "CAST(array() AS array<string>)"


def plans(queries: DataFrame, laws: DataFrame) -> DataFrame:
    """One row a query: references, route, scope, the BM25 text and why it was chosen.

    ``laws`` holds (doc_id, title).
    """
    parsed = Q.rewrite(queries.select("qid", "query")).withColumns({
        "refs": R.legal_refs(F.col("query")), "focus_terms": T.focus_terms(F.col("query"), list(Q.STOP)),
    }).withColumn("initial_route", RT.route(F.col("query"), F.col("refs")))
    parsed = cut(parsed, "routed-parsed")
    law = parsed.filter("initial_route = 'law_anchored_hybrid'").select("qid", F.col("refs.law_name").alias("law_name"))
    scoped = RT.law_scope(law, RT.law_lookup(law, laws, 5))
    guess = parsed.filter("initial_route = 'hybrid_default' AND size(legal_anchor_guess) > 0").select("qid", F.element_at("legal_anchor_guess", 1).alias("law_name"))
    anchored = SE.anchor_scope(RT.law_lookup(guess, laws, 5)).select("qid", F.lit("hybrid_default").alias("route"), "allowed", F.lit("rewrite_legal_anchor_lookup").alias("reason"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("margin"), F.expr(NONE).alias("looked_up"))
    scopes = scoped.unionByName(anchored).withColumnsRenamed({"reason": "lookup_reason", "confidence": "lookup_confidence", "margin": "lookup_margin"})
    out = parsed.join(scopes, "qid", "left")
    text, why = bm25_text()
    words = F.coalesce("allowed", F.expr(NONE))
    return cut(out.withColumns({
        "route": F.coalesce("route", "initial_route"), "allowed": words, "looked_up": F.coalesce("looked_up", F.expr(NONE)), "lookup_reason": F.coalesce("lookup_reason", F.lit("")), "lookup_confidence": F.coalesce("lookup_confidence", F.lit(0.0)),
        "lookup_margin": F.coalesce("lookup_margin", F.lit(0.0)), "bm25_text": F.when(F.col("initial_route") == "hybrid_default", text).otherwise(F.col("query")), "bm25_reason": F.when(F.col("initial_route") == "hybrid_default", why).otherwise(""),
        "hard_types": F.col("query_too_vague") | F.col("lexical_is_weak"),
    }), "routed-plans")


def bm25_text() -> tuple[Column, Column]:
    """The text that BM25 searches for on the default route, by the first rule that holds, and the rule's name."""
    lexical, clean = F.nullif(F.col("lexical_query"), F.lit("")), F.nullif(F.col("clean"), F.lit(""))
    n = F.size(F.filter(F.split(F.coalesce("lexical_query", F.lit("")), " "), lambda w: w != ""))
    rules = [
        (abort() & (F.col("concept_seed") != ""), "weak_query_abort_concept_seed", F.col("concept_seed")), ((F.col("subclass") == "concept_generic") & lexical.isNotNull(), "concept_generic_expanded_lexical", F.col("lexical_expanded")),
        (F.col("query_too_vague"), "query_too_vague", F.coalesce(clean, F.col("query"))), (F.col("lexical_is_weak") & lexical.isNotNull() & (n >= 4), "lexical_weak_expanded", F.col("lexical_expanded")),
        (F.col("lexical_is_weak") & clean.isNotNull(), "lexical_weak_clean", clean), ((n <= 2) & clean.isNotNull(), "lexical_too_short", clean),
    ]
    text, why = F.coalesce(lexical, clean, F.col("query")), F.lit("")
    for test, name, value in reversed(rules):
        text, why = F.when(test, value).otherwise(text), F.when(test, F.lit(name)).otherwise(why)
    return text, why


def abort() -> Column:
    """A weak query that says too little for any search of its own words."""
    words = F.filter(F.split(F.coalesce("lexical_core", F.lit("")), " "), lambda w: w != "")
    content = F.size(F.filter(words, lambda w: ~w.isin(*Q.STOP)))
    kinds = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in ("actor_terms", "action_terms", "object_terms")), F.lit(0))
    tokens = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != ""))
    weak = (F.col("lexical_core").isin("la gi", "quy dinh chung", "ve kiem sat giai")) | (content <= 2) | (F.size(F.array_distinct(words)) <= 2) | F.arrays_overlap("vagueness_flags", F.array(*map(F.lit, SE.WEAK_FLAGS)))
    saved = (content >= 3) | ((F.size("concept_tags") > 0) & (kinds >= 2)) | (tokens("concept_seed") >= 4) | (tokens("title_anchor") >= 4)
    return weak & ~saved


def _scope(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, id): the chunks of the documents that a query may hit."""
    return queries.select("qid", F.explode("allowed").alias("doc_id")).join(chunks.select("id", "doc_id"), "doc_id").select("qid", "id")


def _structured(exact: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(qid, id, doc_id, match_type, rn): the first chunks of the reference of each query; what many queries refer to is looked up once."""
    named = F.struct(*(F.col(f"refs.{c}").alias(c) for c in ("document_number", "document_short", "article_number", "clause_number")))
    asked = exact.select("qid", named.alias("key"))
    keys = asked.select("key").distinct().select(F.col("key").alias("qid"), F.col("key").alias("refs"))
    by_kind = Window.partitionBy("key").orderBy(F.array_position(F.array(*map(F.lit, ("clause", "article", "document"))), F.col("match_type")), "id")
    found = RT.structured_lookup(keys, known.withColumnRenamed("id", "chunk_id")).withColumnsRenamed({"chunk_id": "id", "qid": "key"}).dropDuplicates(["key", "id"])
    first = found.withColumn("rn", F.row_number().over(by_kind)).filter(F.col("rn") <= most).withColumnRenamed("key", "found")
    return asked.join(first, F.col("key").eqNullSafe(F.col("found"))).drop("key", "found")


def _bm25(index: IX.Index, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, id, score, rank) of (qid, text, allowed, k): one search of the free queries and one of the scoped ones."""
    asked = queries.select("qid", F.col("text").alias("query"), "allowed", "k")
    most = asked.agg(F.max("k")).first()[0]
    if most is None:
        return V.top_k(asked.select("qid", F.lit(None).cast(index.postings.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).limit(0), 1)
    free = IX.search(index, asked.filter("size(allowed) = 0"), most)
    inside = asked.filter("size(allowed) > 0")
    both = free.unionByName(IX.search(index, inside, most, allowed=_scope(inside, chunks)))
    return both.join(asked.select("qid", "k"), "qid").filter("rank < k").drop("k")


def _gated(hits: DataFrame, plan: DataFrame, known: DataFrame) -> DataFrame:
    """Hits of the default route through the document-type gate, with new ranks; other routes' as they are."""
    cols = ["qid", "id", "score", "rank"]
    mine = plan.filter("route = 'hybrid_default'").select("qid", F.col("doc_type_prior").alias("prior"), F.col("doc_type_exclude").alias("exclude"), F.col("doc_type_prior").alias("allow"), "hard_types")
    kind = S.bucket(F.col("document_number"), F.lit(""), F.col("title"), F.col("path"))
    rows = hits.join(mine, "qid").join(known.select("id", "title", "path", "document_number"), "id").withColumn("kind", kind)
    rows = rows.withColumns({"local": S.local_admin(F.col("document_number"), F.lit(""), F.col("title"), F.col("path")), "preferred": S.preferred(F.col("kind"), F.col("title"), F.lit(""), F.col("path"))})
    out = S.document_gate(rows.filter("hard_types"), hard=True).unionByName(S.document_gate(rows.filter("NOT hard_types"))).select(*cols)
    by_rank = Window.partitionBy("qid").orderBy("rank", "id")
    return out.withColumn("rank", F.row_number().over(by_rank) - 1).unionByName(hits.join(mine.select("qid"), "qid", "left_anti").select(*cols))


def search(index: IX.Index, queries: DataFrame, chunks: DataFrame, laws: DataFrame, vector: Callable[[DataFrame, int], DataFrame] | None = None, bm25_k: int = 20, vector_k: int = 20, final_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(stages, decisions) of (qid, query).

    ``chunks`` holds (id, doc_id, title, path, article, clause, document_number,
    text) with doc_id as string; ``vector`` takes (qid, allowed) and a number and
    returns (qid, id, score, rank) within the allowed documents.
    """
    known = chunks.select("id", "doc_id", "title", "path", "article", "clause", "document_number", "text")
    plan = plans(queries, laws)
    # Structured lookup answers alone; without hits its queries become narrow ones.
    exact = plan.filter("initial_route = 'structured_exact'")
    structured = _structured(exact, known, max(final_k, bm25_k))
    structured = cut(structured.select("qid", "id", (F.lit(1.0) / F.col("rn")).alias("score"), (F.col("rn") - 1).alias("rank"), "match_type"), "routed-structured")
    answered = structured.select("qid").distinct()
    k = F.when(F.col("route") == "hybrid_default", max(bm25_k, DEFAULT_HITS)).when(F.col("route") == "candidate_docs", max(6, min(bm25_k, CANDIDATE_HITS))).otherwise(bm25_k)
    rest = plan.join(answered, "qid", "left_anti").withColumn("route", F.when(F.col("route") == "structured_exact", "narrow_bm25").otherwise(F.col("route")))
    rest = cut(rest.withColumns({"text": F.col("bm25_text"), "k": k}), "routed-rest")
    raw = cut(_bm25(index, rest, known), "routed-bm25")
    first = cut(_gated(raw, rest, known), "routed-gated")
    # Which queries need vectors.
    anchored = first.join(known, "id").join(rest.select("qid", "refs"), "qid").withColumns({
        "in_document": SE.document_anchor(F.col("refs"), F.col("doc_id"), F.col("title"), F.col("path"), F.col("document_number")), "in_unit": SE.unit_anchor(F.col("refs"), F.col("article"), F.col("clause"), F.col("path")),
    })
    skip = SE.skip_vector(rest.select("qid", SE.has_document(F.col("refs")).alias("has_document")), anchored)
    candidates = rest.filter("route = 'candidate_docs'").select("qid", "allowed", F.col("lookup_confidence").alias("confidence"), F.col("lookup_margin").alias("margin"))
    leave = SE.early_exit(candidates, first.join(known.select("id", "doc_id"), "id")).select("qid", "exit", F.col("reason").alias("exit_reason"))
    gates = rest.join(skip, "qid", "left").join(leave, "qid", "left").select(
        "qid", F.when(F.col("route") == "narrow_bm25", "route").when(F.coalesce("skip", F.lit(False)), "quality_gate").when(F.coalesce("exit", F.lit(False)), "early_exit").otherwise("").alias("vector_skipped"), F.coalesce("exit_reason", F.lit("")).alias("exit_reason"),
    )
    gates = cut(gates, "routed-gates")
    vector_n = F.when(F.col("route") == "candidate_docs", max(6, min(vector_k, CANDIDATE_VECTORS))).otherwise(vector_k)
    asks = rest.join(gates.filter("vector_skipped = ''").select("qid"), "qid", "left_semi").withColumn("vk", vector_n)
    no_hits = raw.limit(0)

    def vectors(asking: DataFrame, name: str) -> DataFrame:
        if vector is None:
            return no_hits
        return cut(vector(asking.select("qid", "allowed"), vector_k).join(asking.select("qid", "vk"), "qid").filter("rank < vk").select("qid", "id", "score", "rank"), name)

    near = vectors(asks, "routed-vectors")
    counts = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    found = rest.select("qid", "route", "allowed", "refs", "looked_up").join(counts(raw, "n_raw"), "qid", "left").join(counts(first, "n_bm25"), "qid", "left").join(counts(near, "n_vector"), "qid", "left").na.fill(0)
    # Scoped default queries without BM25 hits search again without their scope.
    lost = (F.col("route") == "hybrid_default") & (F.size("allowed") > 0) & ~SE.has_document(F.col("refs")) & ((F.col("n_bm25") + F.col("n_vector") == 0) | (F.col("n_bm25") == 0))
    again = (F.col("route") == "exact_doc") & (F.col("n_bm25") + F.col("n_vector") == 0)
    found = cut(found.withColumns({"scope_fallback": lost, "exact_retry": again}).drop("refs"), "routed-found")
    words = rest.join(found.filter("scope_fallback").select("qid"), "qid", "left_semi").select("qid", F.col("query").alias("raw"), "clean", F.col("lexical_query").alias("lexical"), F.col("strong_phrases").alias("intents"), F.col("focus_terms").alias("focus"))
    chosen = cut(SE.fallback_query(words), "routed-fallback")
    wide = max(8, min(12, FALLBACK_HITS))
    fallback = _gated(_bm25(index, chosen.select("qid", F.col("query").alias("text"), F.expr(NONE).alias("allowed"), F.lit(wide).alias("k")), known), rest, known)
    # An exact document without any hit: the lookup's other documents, else a loose search, are really searched.
    retry = SE.exact_retry(found.filter("exact_retry").select("qid", F.col("route").alias("refined"), "allowed", "looked_up"), no_hits)
    retry = cut(rest.drop("route", "allowed", "k").join(retry.select("qid", F.col("refined").alias("route"), "allowed"), "qid").withColumns({"k": k, "vk": vector_n}), "routed-retry")
    second = _bm25(index, retry, known)
    second_near = vectors(retry, "routed-vectors-again")
    merged = V.merge_hits(first.join(chosen.select("qid"), "qid", "left_semi"), fallback, limit=max(16, 2 * wide)).select("qid", "id", "score", "rank")
    bm25 = cut(first.join(chosen.select("qid"), "qid", "left_anti").unionByName(merged).unionByName(second).unionByName(structured.select("qid", "id", "score", "rank")), "routed-all")
    near = near.unionByName(second_near)
    # Fusion only where vectors found something.
    fused_of = near.select("qid").distinct()
    fused = V.rrf(bm25.join(fused_of, "qid", "left_semi"), near).select("qid", "id", "score", "rank").withColumn("rrf_score", F.col("score"))
    fused = cut(fused.unionByName(bm25.join(fused_of, "qid", "left_anti").withColumn("rrf_score", F.lit(0.0))), "routed-fused")
    kept, gone = V.dedup_units(fused.join(known, "id"))
    by_rank = Window.partitionBy("qid").orderBy("rank", "id")
    deduped = kept.withColumn("rank", F.row_number().over(by_rank) - 1)
    scored = SE.evidence(deduped, plan.select("qid", F.col("bm25_text").alias("query"), "refs"))
    reranked = cut(S.heuristic_rerank(scored.select("qid", "id", "rank", "score", "rrf_score", "token_hits", "phrase_hits", "bonus")).select("qid", "id", "rank", "rerank_score"), "routed-reranked")
    # Focus only on the default route, where a family of documents leads.
    family = T.family_key(F.coalesce("title", F.lit("")))
    rows = reranked.join(known, "id").withColumn("family", F.coalesce(family, F.lit("")))
    lead = rows.filter("rank < 12 AND family <> ''").groupBy("qid", "family").agg(F.sum(1 / (60 + F.col("rank"))).alias("s"))
    top = lead.groupBy("qid").agg(F.count(F.lit(1)).alias("families"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("ss"))  # twelve rows a query at most
    share = F.element_at("ss", 1) / F.aggregate("ss", F.lit(0.0), lambda a, x: a + x)
    n = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("chunks"))
    focus = plan.filter("route = 'hybrid_default'").join(top, "qid").join(n, "qid")
    run, _ = SE.focus_gate(share, 2 * share - 1, F.col("families"), F.col("chunks"), F.col("vagueness_level"), F.lit(True))
    focus = cut(focus.filter(run).select("qid", "query", "subclass", "concept_phrases", "actor_terms", "action_terms", "object_terms", "focus_terms"), "routed-focus")
    moved = SE.focus_rerank(rows.join(focus.select("qid"), "qid", "left_semi"), focus).select("qid", "id", "rank", "rerank_score")
    last = cut(reranked.join(focus.select("qid"), "qid", "left_anti").unionByName(moved).withColumnRenamed("rerank_score", "score"), "routed-last")
    final, late = V.cutoff(last, final_k)
    gone = gone.select("qid", "id", "rank", "score", "reason").unionByName(late.select("qid", "id", "rank", "score", "reason"))
    stages = {"structured": structured, "bm25": bm25.join(answered, "qid", "left_anti"), "vector": near, "rrf": fused, "deduped": deduped, "reranked": last, "final": final, "filtered": gone}
    out = None
    for name, df in stages.items():
        reason = F.col("reason") if name == "filtered" else F.lit(None).cast("string")
        part = df.select("qid", F.lit(name).alias("stage"), "id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(int(name != "filtered")).alias("kept"), reason.alias("filter_reason"))
        out = part if out is None else out.unionByName(part)
    late_route = retry.select("qid", F.col("route").alias("retried"), F.col("allowed").alias("retry_allowed"))
    decisions = (
        plan.select("qid", "initial_route", "route", "allowed", "lookup_reason", "bm25_reason").join(rest.select("qid", F.col("route").alias("rest_route")), "qid", "left").join(gates, "qid", "left")
        .join(found.select("qid", "n_raw", "n_bm25", "n_vector", "scope_fallback", "exact_retry"), "qid", "left").join(late_route, "qid", "left").join(chosen.select("qid", F.col("reason").alias("fallback_reason")), "qid", "left")
        .join(focus.select("qid", F.lit(True).alias("focused")), "qid", "left").join(counts(structured, "n_structured"), "qid", "left").join(counts(final, "n_final"), "qid", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    word = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out, decisions.select(
        "qid", "initial_route", F.coalesce("retried", "rest_route", "route").alias("route"), F.when(yes("scope_fallback"), F.expr(NONE)).otherwise(F.coalesce("retry_allowed", "allowed")).alias("allowed"), "lookup_reason", "bm25_reason",
        F.when(F.col("n_structured") > 0, "structured_lookup").otherwise(F.coalesce("vector_skipped", F.lit(""))).alias("vector_skipped"), word("exit_reason"), yes("scope_fallback"), word("fallback_reason"), yes("exact_retry"), yes("focused"),
        number("n_structured"), number("n_raw"), number("n_bm25"), number("n_vector"), number("n_final"),
    )
