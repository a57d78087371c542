"""The search of a batch of queries stage by stage: anchors, gates, recall passes, fallbacks, focus and the snapshot.

Frames hold one row for each query (qid) or each hit (qid, id, score, rank from
0).  Decisions of a query are boolean columns, so that a fallback is a second
batched search over the queries that need it, never a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.functions import text as T
from lexloom.operators import index as IX
from lexloom.operators import retrieval as V
from lexloom.operators import rewrite as Q
from lexloom.operators import scoring as S
from lexloom.sources.shared import cut

#: Hits of each recall pass (fixed values).
PASS_HITS = {"core": 20, "expanded": 20, "title": 12, "recovery": 16}
#: Words that say nothing of a query's topic, and words of legal actions (fixed values).
GENERIC_WORDS = ("quy", "dinh", "chung", "ve", "la", "gi", "nhu", "the", "nao", "khi", "ap", "dung", "thuc", "te", "can", "luu", "y", "nhung", "trong")
ACTION_WORDS = ("xu", "ly", "ky", "luat", "tham", "quyen", "dieu", "kien", "trach", "nhiem", "hieu", "luc", "tuyen", "dung", "cham", "dut", "nghia", "vu")
WEAK_FLAGS = ("weak_structure", "low_token_variety", "too_short", "missing_actor", "missing_action")
BROAD_TOPICS = ("general_legal", "civil_service", "labor", "administrative_sanction")


# --- anchors and projections ---------------------------------------------------------------------


def has_document(refs: Column) -> Column:
    """A reference names a document in any form."""
    return (refs["document_number"] != "") | (refs["document_short"] != "") | (refs["document_loose"] != "")


def document_anchor(refs: Column, doc_id: Column, title: Column, path: Column, number: Column) -> Column:
    """The hit is of the referenced document: by its number, or named anywhere in id, title, path or number."""
    full, loose, short = R.document_number(refs["document_number"]), R.document_number(refs["document_loose"]), F.upper(F.trim(refs["document_short"]))
    own = R.document_number(number)
    hay = F.upper(F.concat_ws(" ", *(F.coalesce(x.cast("string"), F.lit("")) for x in (doc_id, title, path, number))))
    around = F.regexp_like(hay, F.concat(F.lit(r"(?<!\d)\Q"), short, F.lit(r"\E(?!\d)")))
    named = [(x != "") & ((own == x) | F.contains(hay, x)) for x in (full, loose)]
    return F.coalesce(named[0] | named[1] | ((short != "") & around), F.lit(False))


def unit_number(value: Column, path: Column, word: str) -> Column:
    """Digits of an article or clause, else those that follow its word in the path."""
    return F.coalesce(F.nullif(R.numeric_ref(value), F.lit("")), F.regexp_extract(F.lower(T.fold(F.coalesce(path, F.lit("")))), rf"{word}\s+(\d+)", 1))


def unit_anchor(refs: Column, article: Column, clause: Column, path: Column) -> Column:
    """The hit is of the referenced article and clause; true if none is asked for."""
    want_a, want_c = R.numeric_ref(refs["article_number"]), R.numeric_ref(refs["clause_number"])
    return ((want_a == "") | (unit_number(article, path, "dieu") == want_a)) & ((want_c == "") | (unit_number(clause, path, "khoan") == want_c))


def article_ref(article: Column, clause: Column) -> Column:
    """``article - clause``, whichever is there, else null."""
    a, c = (F.nullif(F.trim(F.coalesce(x.cast("string"), F.lit(""))), F.lit("")) for x in (article, clause))
    return F.when(a.isNotNull() | c.isNotNull(), F.concat_ws(" - ", a, c))


def compact_hits(hits: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, chunk_id, score, rank, doc_id, article_ref) of the first hits."""
    return hits.filter(F.col("rank") < limit).select("qid", F.col("id").alias("chunk_id"), "score", "rank", "doc_id", article_ref(F.col("article"), F.col("clause")).alias("article_ref"))


def shortlist(hits: DataFrame, selected: DataFrame, limit: int) -> DataFrame:
    """Hits (doc_id, family) of a query's selected documents or families, all hits if none is; the first ``limit`` by rank.

    ``selected`` holds (qid, docs, families) arrays of a few names.
    """
    rows = hits.join(selected, "qid", "left")
    inside = F.coalesce(F.array_contains("docs", F.col("doc_id")), F.lit(False)) | F.coalesce((F.col("family") != "") & F.array_contains("families", F.col("family")), F.lit(False))
    any_in = F.max(inside.cast("int")).over(Window.partitionBy("qid"))
    rows = rows.withColumn("_in", inside).withColumn("_any", any_in).filter((F.col("_any") == 0) | F.col("_in"))
    w = Window.partitionBy("qid").orderBy("rank", "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(1, limit)).withColumn("rank", F.col("_n") - 1).drop("_in", "_any", "_n", "docs", "families")


def scope_meet(selected: Column, allowed: Column) -> Column:
    """Selected ids that are allowed; the allowed ones if none of the selected is, and the selected ones without a scope."""
    both = F.array_intersect(selected, allowed)
    return F.when(F.size(allowed) == 0, selected).when(F.size(both) > 0, both).otherwise(allowed)


# --- decisions of a query ------------------------------------------------------------------------


def skip_vector(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, skip): the first BM25 hit is of the referenced document, and one of three is of its article and clause.

    ``queries`` holds (qid, has_document); ``hits`` (qid, rank, in_document, in_unit).
    """
    top = hits.filter("rank < 3").groupBy("qid").agg(F.bool_or((F.col("rank") == 0) & F.col("in_document")).alias("first"), F.bool_or(F.col("in_document") & F.col("in_unit")).alias("some"))
    return queries.select("qid", "has_document").join(top, "qid", "left").select("qid", F.coalesce(F.col("has_document") & F.col("first") & F.col("some"), F.lit(False)).alias("skip"))


def early_exit(queries: DataFrame, hits: DataFrame, min_hits: int = 2, confidence: float = 0.86, margin: float = 0.02, gap: float = 0.015) -> DataFrame:
    """(qid, exit, reason, score_gap): may vector search be left out for a scoped query?

    ``queries`` holds (qid, allowed, confidence, margin); ``hits`` (qid, doc_id, score, rank).
    """
    h = hits.join(queries.select("qid", "allowed"), "qid")
    top = F.col("rank") < 4
    doc = F.nullif(F.trim(F.col("doc_id").cast("string")), F.lit(""))
    per = h.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(top, doc)).alias("named"), F.max(F.when(top, (~F.array_contains("allowed", doc)).cast("int"))).alias("outside"),
        F.count_distinct(F.when(top, doc)).alias("docs"), F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("s1"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("s2"),
    )
    allowed = F.size(F.filter("allowed", lambda x: F.trim(x) != ""))
    lead = F.round(F.col("s1") - F.col("s2"), 9) + 0.0
    reason = (
        F.when(F.col("n").isNull(), "no_bm25_hits").when(allowed <= 0, "no_allowed_doc_ids").when(F.col("n") < max(2, min_hits), "insufficient_bm25_hits").when(F.col("named") == 0, "missing_top_doc_ids")
        .when(F.col("outside") == 1, "top_rows_outside_scope").when((allowed == 1) & (lead >= -0.01), "single_doc_scope").when((allowed <= 2) & (F.col("docs") <= 1) & (lead >= -0.02), "small_scope_consistent_doc")
        .when((F.col("confidence") >= confidence) & ((F.col("margin") >= margin) | (F.col("docs") <= 1)) & (lead >= gap), "scoped_bm25_strong_lead").otherwise("no_strong_lead")
    )
    out = queries.join(per, "qid", "left").withColumn("reason", reason)
    some = F.col("reason").isin("single_doc_scope", "small_scope_consistent_doc", "scoped_bm25_strong_lead")
    return out.select("qid", some.alias("exit"), "reason", F.when(some | F.col("reason").isin("no_strong_lead"), lead).otherwise(0.0).alias("score_gap"))


def focus_gate(score: Column, margin: Column, families: Column, chunks: Column, vagueness: Column, trusted: Column) -> tuple[Column, Column]:
    """Whether focus reranking runs, and the confidence of the best family."""
    run = trusted & (vagueness != "hard") & (chunks >= 4) & ((families <= 1) | (score >= 0.55) | (margin >= 0.15))
    return run, score + F.least(F.lit(0.4), margin)


def vector_gate(confidence: Column, flags: Column, topic: Column, title_hits: Column, core_hits: Column, expanded_hits: Column, families: Column, margin: Column, abort: Column) -> Column:
    """Whether recalling documents of a concept needs vector search."""
    weak = F.arrays_overlap(flags, F.array(*map(F.lit, WEAK_FLAGS)))
    thin = (title_hits < 3), (core_hits < 4), (expanded_hits < 6)
    return (
        F.when((families == 0) | (margin < 0.10) | (abort & (thin[0] | thin[1])), True).when((confidence < 0.45) & ~weak, False)
        .otherwise(weak | thin[0] | thin[1] | thin[2] | (topic.isin(*BROAD_TOPICS) & (title_hits < 5)))
    )


def recoverable(core: Column, tags: Column, actors: Column, actions: Column, objects: Column, title: Column, abort: Column) -> Column:
    """A vague query still says enough for a recovery pass."""
    words = F.array_distinct(F.filter(T.tokens(core, query=True), lambda w: (F.length(w) > 1) & ~w.isin("la", "gi", "ve", "can", "chuc", "quan")))
    kinds = sum((F.when(F.size(x) > 0, 1).otherwise(0) for x in (actors, actions, objects)), F.lit(0))
    heads = T.tokens(title, query=True)
    return ~abort & ((F.size(words) >= 2) | ((F.size(tags) > 0) & (kinds >= 2)) | ((F.size(heads) >= 4) & ~F.arrays_overlap(heads, F.array(F.lit("la"), F.lit("gi"), F.lit("ve")))))


def generic_query(words: Column) -> Column:
    """Two tokens at most, or one at most that has a topic."""
    return (F.size(words) <= 2) | (F.size(F.filter(words, lambda w: ~w.isin(*GENERIC_WORDS))) <= 1)


def fallback_query(plans: DataFrame) -> DataFrame:
    """(qid, query, reason) from (qid, raw, clean, lexical, intents, focus): the text of a second, unscoped search."""
    q = plans.select(
        "qid", *(T.tokens(F.coalesce(F.col(c), F.lit("")), query=True).alias(c) for c in ("raw", "clean", "lexical")),
        F.filter(F.transform(F.coalesce("intents", F.array().cast("array<string>")), lambda x: T.tokens(x, query=True)), lambda x: F.size(x) > 0).alias("intents"),
        T.tokens(F.array_join(F.coalesce("focus", F.array().cast("array<string>")), " "), query=True).alias("focus"),
    )
    none, actions = F.array().cast("array<string>"), F.array(*map(F.lit, ACTION_WORDS))

    def first(*names: str) -> Column:
        out = none
        for n in reversed(names):
            out = F.when(F.size(n) > 0, F.col(n)).otherwise(out)
        return out

    plain = (F.size("lexical") == 0) | generic_query(F.col("lexical"))
    mend = (F.size("lexical") > 0) & (F.size("clean") > 0) & ~F.arrays_overlap("lexical", actions) & F.arrays_overlap("clean", actions)
    q = q.withColumn("base", F.when(mend, F.col("clean")).when(plain, first("clean", "lexical", "raw")).otherwise(F.col("lexical")))
    q = q.withColumn("reason", F.when(mend, "rewrite_clean_action_repair").when(plain, "rewrite_clean").otherwise("rewrite_lexical"))
    intent = (F.size("intents") > 0) & (generic_query(F.col("base")) | (F.size("base") < 4))
    q = q.withColumn("reason", F.when(intent, "intent_template").otherwise(F.col("reason"))).withColumn("base", F.when(intent, F.try_element_at("intents", F.lit(1))).otherwise(F.col("base")))
    nothing = F.size("base") == 0
    q = q.withColumn("reason", F.when(nothing, "raw_query").otherwise(F.col("reason"))).withColumn("base", F.when(nothing, F.col("raw")).otherwise(F.col("base")))
    more = ((F.size("base") < 3) | generic_query(F.col("base"))) & (F.size("focus") > 0)
    q = q.withColumn("reason", F.when(more, F.concat("reason", F.lit("+focus_terms"))).otherwise(F.col("reason")))
    q = q.withColumn("base", F.when(more, F.slice(F.array_distinct(F.concat("base", "focus")), 1, 12)).otherwise(F.col("base")))
    return q.select("qid", F.array_join("base", " ").alias("query"), "reason")


# --- recall, scopes and fallbacks ----------------------------------------------------------------


def pass_hits(index: IX.Index, passes: DataFrame) -> DataFrame:
    """(qid, pass, id, score, rank from 0): every pass of every query in one search, each with its own number of hits."""
    keyed = passes.select(F.struct("qid", "pass").alias("key"), "query")
    k = F.element_at(F.create_map(*[F.lit(x) for kv in PASS_HITS.items() for x in kv]), F.col("pass"))
    found = IX.search(index, keyed, max(PASS_HITS.values()), qid="key")
    return found.withColumnRenamed("qid", "key").select("key.qid", "key.pass", "id", "score", "rank").filter(F.col("rank") < k)


def recall(index: IX.Index, plans: DataFrame, limit: int = 72) -> DataFrame:
    """(qid, id, score, rank, passes): the passes of concept queries as one list, the best score of each hit, ``limit`` at most."""
    order = F.create_map(*[x for k, p in enumerate(PASS_HITS) for x in (F.lit(p), F.lit(k))])
    hits = pass_hits(index, Q.recall_passes(plans))
    best = hits.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min(F.struct(order[F.col("pass")].alias("at"), "rank")).alias("seen"), F.array_sort(F.collect_set("pass")).alias("passes"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "seen.at", "seen.rank", "id")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).select("qid", "id", "score", (F.col("rn") - 1).alias("rank"), "passes")


def anchor_scope(lookup: DataFrame, least: float = 0.86, docs: int = 3) -> DataFrame:
    """(qid, allowed): the first documents of a law lookup (qid, doc_id, confidence, rank) whose best is sure enough."""
    best = F.max(F.when(F.col("rank") == 1, F.col("confidence")))
    per = lookup.filter(F.col("rank") <= docs).groupBy("qid").agg(best.alias("c"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("ds"))
    return per.filter(F.col("c") >= least).select("qid", F.transform("ds", lambda d: d["doc_id"]).alias("allowed"))


def scope_fallback(index: IX.Index, queries: DataFrame, scoped: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank, fallback): scoped hits, and for scoped queries without any an unscoped search by the fallback query.

    ``queries`` holds (qid, scoped, has_document, query): the fallback text; a query that names a document keeps its scope.
    """
    k = max(8, min(12, k))
    empty = queries.join(scoped.select("qid").distinct(), "qid", "left_anti").filter("scoped AND NOT has_document")
    more = IX.search(index, empty.select("qid", "query"), k)
    return scoped.select("qid", "id", "score", "rank", F.lit(False).alias("fallback")).unionByName(more.select("qid", "id", "score", "rank", F.lit(True).alias("fallback")))


def exact_retry(queries: DataFrame, hits: DataFrame, docs: int = 3, loose: int = 5) -> DataFrame:
    """(qid, refined, allowed, retried): queries scoped to one exact document that find nothing there get the lookup's other documents.

    ``queries`` holds (qid, refined, allowed, looked_up), the lookup's documents in order.
    """
    found = hits.select("qid").distinct().withColumn("_found", F.lit(True))
    need = (F.col("refined") == "exact_doc") & F.col("_found").isNull()
    others = F.slice(F.array_except("looked_up", "allowed"), 1, docs)
    candidates = F.when(F.size(others) > 0, others).otherwise(F.slice("looked_up", 1, docs))
    some = F.size(candidates) > 0
    return queries.join(found, "qid", "left").select(
        "qid", F.when(need & some, "candidate_docs").when(need, "loose").otherwise(F.col("refined")).alias("refined"),
        F.when(need & some, candidates).when(need & (F.size("looked_up") > 0), F.slice("looked_up", 1, loose)).otherwise(F.col("allowed")).alias("allowed"), need.alias("retried"),
    )


def legacy_families(docs: DataFrame, families: int = 3, most: int = 6) -> DataFrame:
    """(qid, docs, families) from candidates (qid, doc_id, family, score, rank): families by summed score, 2 if the first leads by 1.25 times, 3 at most."""
    per = docs.filter("family <> ''").groupBy("qid", "family").agg(F.round(F.sum("score"), 9).alias("total"), F.min("rank").alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc("total"), "first", "family")
    ranked = per.withColumn("n", F.row_number().over(w)).withColumn("top1", F.max("total").over(Window.partitionBy("qid"))).filter(F.col("n") <= max(families, 2))
    ranked = ranked.withColumn("top2", F.max(F.when(F.col("n") == 2, F.col("total"))).over(Window.partitionBy("qid")))
    keep = F.when((F.col("top2") > 0) & (F.col("top1") >= F.col("top2") * 1.25), min(2, families)).otherwise(F.when(F.col("top2").isNull(), families).otherwise(min(families, 3)))
    chosen = ranked.filter(F.col("n") <= keep).select("qid", "family", "n")
    mine = docs.join(chosen, ["qid", "family"])
    one = mine.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    by_rank = Window.partitionBy("qid").orderBy("rank", "doc_id")
    ids = one.withColumn("k", F.row_number().over(by_rank)).filter(F.col("k") <= most).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    names = chosen.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "family"))), lambda x: x["family"]).alias("families"))
    return names.join(ids, "qid", "left")


# --- focus -----------------------------------------------------------------------------------------


def _targets(hits: DataFrame, key: str, name: str) -> DataFrame:
    """(qid, name): up to two keys in order of appearance that stand twice in the first twelve, first among three."""
    per = hits.filter((F.col("rank") < 12) & (F.coalesce(F.col(key).cast("string"), F.lit("")) != "")).groupBy("qid", key).agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("first"))
    ok = per.filter("c >= 2 AND first <= 2").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("first", F.col(key).cast("string").alias("key")))).alias("x"))
    return ok.select("qid", F.transform(F.slice("x", 1, 2), lambda v: v["key"]).alias(name))


def focus_rerank(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """Hits with ``focus_bonus``, the new ``rerank_score`` and ``rank``: rows of the documents and families that dominate the first twelve move up.

    ``hits`` holds (qid, id, rank, rerank_score, doc_id, family, title, path, article, clause, text), ``plans``
    (qid, query, subclass, concept_phrases, actor_terms, action_terms, object_terms, focus_terms).
    """
    none = F.array().cast("array<string>")
    words = lambda c: F.array_distinct(T.tokens(F.array_join(F.coalesce(F.col(c), none), " "), query=True, normalise=True)).alias(c)
    plan = plans.select("qid", "subclass", F.array_distinct(F.coalesce("concept_phrases", none)).alias("phrases"), words("actor_terms"), words("action_terms"), words("object_terms"), words("focus_terms"), F.array_distinct(T.tokens(F.col("query"), query=True, normalise=True)).alias("query_words"))
    rows = hits.join(plan, "qid", "left").join(_targets(hits, "doc_id", "target_docs"), "qid", "left").join(_targets(hits, "family", "target_families"), "qid", "left")
    in_doc = F.coalesce(F.array_contains("target_docs", F.col("doc_id").cast("string")), F.lit(False))
    in_family = F.coalesce(F.array_contains("target_families", F.col("family")), F.lit(False))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "path", "article")]
    tail = [F.coalesce(F.col("clause").cast("string"), F.lit("")), F.coalesce(F.substring("text", 1, 800), F.lit(""))]
    rows = rows.withColumns({"_doc": in_doc, "_family": in_family, "_head": T.token_text(F.concat_ws(" ", *parts), query=True), "_hay": T.tokens(F.concat_ws(" ", *parts, *tail), query=True, normalise=True)})
    text = F.array_join("_hay", " ")
    held = lambda c: F.size(F.array_intersect(c, F.col("_hay")))
    rows = rows.withColumns({
        "_heading": F.size(F.filter("phrases", lambda p: (p != "") & F.contains(F.col("_head"), p))), "_concept": F.size(F.filter("phrases", lambda p: (p != "") & F.contains(text, p))),
        **{f"_{n}": held(F.col(c)) for n, c in (("actor", "actor_terms"), ("action", "action_terms"), ("object", "object_terms"), ("focus", "focus_terms"), ("query", "query_words"))},
    })
    c = F.col
    capped = lambda most, x: F.least(F.lit(most), x)
    article = F.coalesce(unit_number(c("article"), c("path"), "dieu").try_cast("int"), F.lit(0))
    concept = F.when(c("subclass") == "concept_generic", F.when(article.between(1, 3), 0.004).when(article > 0, -0.001).otherwise(0.0) + F.when((c("_concept") == 0) & (c("_action") == 0), -0.001).otherwise(0.0)).otherwise(0.0)
    bonus = (
        F.when(c("_doc"), 0.006).otherwise(0.003) + capped(0.010, c("_heading") * 0.0025) + capped(0.010, c("_concept") * 0.0020)
        + F.when((c("_actor") > 0) & (c("_action") > 0), capped(0.010, (c("_actor") + c("_action")) * 0.0018)).when(c("_action") > 0, capped(0.006, c("_action") * 0.0015)).otherwise(0.0)
        + capped(0.005, c("_object") * 0.0015) + capped(0.004, c("_focus") * 0.0010) + capped(0.003, c("_query") * 0.0007) + concept
    )
    rows = rows.withColumn("focus_bonus", F.when(c("_doc") | c("_family"), F.round(bonus, 6)).otherwise(0.0)).withColumn("rerank_score", c("rerank_score") + c("focus_bonus"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("rerank_score", 12)), "rank", "id")
    return rows.withColumn("original_rank", c("rank")).withColumn("rank", F.row_number().over(w) - 1).select(*hits.columns, "original_rank", "focus_bonus")


def evidence(hits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Hits (qid, title, path, article, clause, document_number, text, ...) with ``token_hits``, ``phrase_hits`` and the ``bonus`` of references of (qid, query, refs)."""
    words = parsed.select("qid", F.array_distinct(T.tokens(F.col("query"), query=True, normalise=True)).alias("ws"), T.phrases(F.col("query"), 6).alias("ps"), "refs")
    scored = hits.join(words, "qid").withColumn("_hay", T.tokens(F.concat_ws(" ", "title", "path", F.substring("text", 1, 1200)), normalise=True))
    wanted, named = has_document(F.col("refs")), document_anchor(F.col("refs"), F.col("doc_id"), F.col("title"), F.col("path"), F.col("document_number"))
    asked = lambda ref, ok: F.when(F.col("refs")[ref] != "", ok)
    unit = lambda value, word: unit_number(F.col(value), F.col("path"), word)
    bonus = S.reference_bonus(
        wanted, named, asked("article_number", unit("article", "dieu") == R.numeric_ref(F.col("refs.article_number"))), asked("clause_number", unit("clause", "khoan") == R.numeric_ref(F.col("refs.clause_number"))), F.lit(None).cast("boolean"),
    )
    return scored.withColumns({"token_hits": F.size(F.array_intersect("ws", "_hay")), "phrase_hits": F.size(F.filter("ps", lambda p: F.contains(F.array_join("_hay", " "), p))), "bonus": bonus}).drop("ws", "ps", "refs", "_hay")


# --- snapshot ---------------------------------------------------------------------------------------


def snapshot(index: IX.Index, queries: DataFrame, chunks: DataFrame, vector_hits: DataFrame | None = None, bm25_k: int = 80, final_k: int = 10) -> DataFrame:
    """(qid, stage, id, rank, score, kept, filter_reason): every stage of the search of (qid, query).

    Stages: bm25, vector, rrf, deduped, reranked, final, filtered.  Queries
    whose first BM25 hits are already of the document, article and clause that
    they name take no vector hits.  ``chunks`` holds (id, doc_id, title, path,
    article, clause, document_number, text); ranks count from 0.
    """
    parsed = queries.select("qid", "query", R.legal_refs(F.col("query")).alias("refs"))
    bm25 = IX.search(index, parsed, bm25_k)
    known = chunks.select("id", "doc_id", "title", "path", "article", "clause", "document_number", "text")
    rows = bm25.join(known, "id").join(parsed.select("qid", "refs"), "qid")
    rows = rows.withColumns({
        "in_document": document_anchor(F.col("refs"), F.col("doc_id"), F.col("title"), F.col("path"), F.col("document_number")), "in_unit": unit_anchor(F.col("refs"), F.col("article"), F.col("clause"), F.col("path")),
    })
    stages = {"bm25": bm25}
    fused = bm25
    if vector_hits is not None:
        skipped = skip_vector(parsed.select("qid", has_document(F.col("refs")).alias("has_document")), rows).filter("skip").select("qid")
        stages["vector"] = cut(vector_hits.join(skipped, "qid", "left_anti"), "snapshot-vector")
        fused = V.rrf(bm25, stages["vector"])
    stages["rrf"] = fused
    kept, gone = V.dedup_units(fused.join(known, "id").withColumn("doc_id", F.col("doc_id").cast("string")))
    by_rank = Window.partitionBy("qid").orderBy("rank", "id")
    kept = kept.withColumn("rank", F.row_number().over(by_rank) - 1)
    stages["deduped"] = kept
    scored = evidence(kept.withColumn("rrf_score", F.col("score") if vector_hits is not None else F.lit(0.0)), parsed)
    reranked = S.heuristic_rerank(scored.select("qid", "id", "rank", "score", "rrf_score", "token_hits", "phrase_hits", "bonus")).select("qid", "id", "rank", F.col("rerank_score").alias("score"))
    stages["reranked"] = reranked
    stages["final"], late = V.cutoff(reranked, final_k)
    stages["filtered"] = gone.select("qid", "id", "rank", "score", "reason").unionByName(late.select("qid", "id", "rank", "score", "reason"))
    out = None
    for name, df in stages.items():
        reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
        part = df.select("qid", F.lit(name).alias("stage"), "id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(int(name != "filtered")).alias("kept"), reason.alias("filter_reason"))
        out = part if out is None else out.unionByName(part)
    return out
