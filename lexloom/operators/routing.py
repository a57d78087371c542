"""Routes, law-name lookup and structured lookup over batches of parsed queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.functions import text as T

#: (BM25 hits, vector hits) by route (fixed values).
BUDGETS = {"structured_exact": (80, 30), "narrow_bm25": (80, 0), "law_anchored_hybrid": (80, 30), "hybrid_default": (60, 30), "doc_scoped_candidate": (10, 8)}
MODES = {"structured_exact": "narrow", "narrow_bm25": "narrow", "law_anchored_hybrid": "law_anchored_broad", "hybrid_default": "broad"}


def route(query: Column, refs: Column | None = None) -> Column:
    r = R.legal_refs(query) if refs is None else refs
    n = F.size(T.tokens(query, query=True))
    doc = (r["document_number"] != "") | (r["document_short"] != "") | (r["document_loose"] != "")
    art, chapter = (r["article_number"] != "") | (r["clause_number"] != ""), r["chapter"] != ""
    return (
        F.when(doc & (art | (chapter & (n <= 12))), "structured_exact").when(doc | art | chapter, "narrow_bm25")
        .when((r["law_name"] != "") & (n <= 5), "narrow_bm25").when(r["law_name"] != "", "law_anchored_hybrid").otherwise("hybrid_default")
    )


def mode(route_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), route_)


def budget(route_: Column) -> Column:
    """(bm25_k, vector_k) of a route."""
    return F.element_at(F.create_map(*[x for k, (a, b) in BUDGETS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("bm25_k"), F.lit(b).alias("vector_k")))]), route_)


def law_lookup(queries: DataFrame, laws: DataFrame, k: int = 3, least: float = 0.65) -> DataFrame:
    """(qid, doc_id, confidence, margin, rank): share of the law name's words in a folded title.

    A title that has at least ``least`` of n words has one of any
    n - ceil(least * n) + 1 of them: queries meet titles on so many of their
    rarest words only, and the candidates' whole titles decide.
    """
    q = queries.filter(F.col("law_name") != "").select("qid", F.array_distinct(F.split("law_name", " ")).alias("ws")).withColumn("n", F.size("ws"))
    titles = laws.select("doc_id", F.array_distinct(T.ascii_tokens(F.col("title"))).alias("tws"))
    words = titles.select("doc_id", F.explode("tws").alias("w"))
    asked = q.select("qid", "n", F.explode("ws").alias("w"))
    seen = words.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").count()
    rarest = Window.partitionBy("qid").orderBy(F.coalesce("count", F.lit(0)), "w")
    prefix = asked.join(seen, "w", "left").withColumn("at", F.row_number().over(rarest)).filter((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & F.col("count").isNotNull())
    pairs = prefix.select("qid", "w").join(words, "w").select("qid", "doc_id").distinct()
    whole = pairs.join(q, "qid").join(titles, "doc_id")
    s = whole.select("qid", "doc_id", (F.size(F.array_intersect("ws", "tws")) / F.col("n")).alias("confidence"), F.size("tws").alias("size")).filter(F.col("confidence") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), "size", "doc_id")
    out = s.withColumn("margin", F.col("confidence") - F.coalesce(F.lead("confidence").over(w), F.lit(0.0))).withColumn("rn", F.row_number().over(w))
    return out.filter(F.col("rn") <= k).withColumnRenamed("rn", "rank")


#: Words of a law's name that tell no law from another (fixed values).
PLAIN_NAME = ("luat", "bo", "ve", "so", "cac", "va", "cua", "nam")


def law_scope(queries: DataFrame, lookup: DataFrame, docs: int = 3, soft: int = 5) -> DataFrame:
    """(qid, route, allowed, reason, confidence, margin, looked_up) of law-anchored queries (qid, law_name).

    ``lookup`` holds up to ``soft`` documents of each by rank.  An exact match
    that stands alone scopes to it; a good one to its first documents, trimmed
    where the first leads; else the search is loose, softly scoped to what was
    found unless the name says too little.  Thresholds are fixed values.
    """
    name = F.split("law_name", " ")
    specific = F.least(F.lit(1.0), F.size(F.filter(name, lambda w: ~w.isin(*PLAIN_NAME))) / 2)
    per = lookup.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("c"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("confidence"))), F.lit(0.0)).alias("c2"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda d: d["doc_id"]).alias("looked_up"),
    )
    q = queries.withColumn("specific", specific).join(per, "qid", "left")
    margin, many, equal = F.round(F.col("c") - F.col("c2"), 9), F.size("looked_up"), F.abs(F.col("c") - F.col("c2")) <= 0.01
    generic = F.col("law_name").rlike(r"^(luat|bo luat) ve\b") & (F.col("specific") < 0.60)
    vague = F.col("specific") < 0.50
    exact = (F.col("c") >= 0.92) & ~equal & (margin >= 0.10) & (many == 1) & (F.col("specific") >= 0.75)
    candidate = (F.col("c") >= 0.75) & ~generic
    softly = (F.col("c") >= 0.78) & ~(generic & (many <= 1)) & ~vague
    promoted = ~exact & ~candidate & (F.col("c") >= 0.90) & (F.col("specific") >= 0.80) & (many == 1)
    trim = F.when(~equal & (F.col("c") >= 0.90) & (margin >= 0.05), 1).when(~equal & (F.col("c") >= 0.84) & (margin >= 0.02), 2).otherwise(docs)
    route_ = F.when(F.col("c").isNull(), "loose").when(exact, "exact_doc").when(candidate | promoted, "candidate_docs").otherwise("loose")
    why = (
        F.when(F.col("law_name") == "", "no_law_name").when(F.col("c").isNull(), "no_match").when(exact, "exact_confidence_margin")
        .when(candidate, F.concat(F.when(equal | (margin <= 0.025), "candidate_low_margin_or_tie").when(many > 1, "candidate_multiple_docs").otherwise("candidate_confidence"), F.when(trim < F.least(many, F.lit(docs)), F.concat(F.lit("|candidate_trim_top"), trim.cast("string"))).otherwise("")))
        .when(promoted, "loose_promoted_single_doc_confident").when(F.col("c") < 0.75, "confidence_too_low").otherwise("specificity_too_low")
    )
    none = F.slice("looked_up", 1, 0)
    allowed = F.when(exact | promoted, F.slice("looked_up", 1, 1)).when(candidate, F.slice("looked_up", 1, F.least(trim, F.lit(docs)))).when(softly, F.slice("looked_up", 1, soft)).otherwise(none)
    return q.select("qid", route_.alias("route"), F.coalesce(allowed, F.array().cast("array<string>")).alias("allowed"), why.alias("reason"), F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce(margin, F.lit(0.0)).alias("margin"), F.coalesce("looked_up", F.array().cast("array<string>")).alias("looked_up"))


def refined_route(hits: DataFrame, exact: float = 0.92, candidate: float = 0.75, margin: float = 0.10) -> DataFrame:
    """Per law-anchored query: exact_doc, candidate_docs or loose, and the scoped document ids."""
    one = hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("c"), F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("m"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("ds"))
    kind = F.when((F.col("c") >= exact) & (F.col("m") >= margin), "exact_doc").when(F.col("c") >= candidate, "candidate_docs").otherwise("loose")
    ids = F.transform("ds", lambda d: d["doc_id"])
    return one.select("qid", kind.alias("refined"), F.when(kind == "exact_doc", F.slice(ids, 1, 1)).when(kind == "candidate_docs", ids).otherwise(F.slice(ids, 1, 0)).alias("allowed"))


def structured_lookup(queries: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Chunks of the referenced document with the match's kind: clause, article or document.

    Query and chunk ids are keys.  A query has one number and a chunk's own are
    distinct, so no pair is met twice and none has to be sought among the rows.
    Chunks that bring ``own_number`` and ``own_short`` are not asked for their
    document_number.  ``few`` says that the queries are known to fit a broadcast: then each chunk
    meets its queries where it is and nothing is shuffled.
    """
    key = F.coalesce(F.nullif(F.col("refs.document_number"), F.lit("")), F.nullif(F.col("refs.document_short"), F.lit("")))
    q = queries.select("qid", key.alias("number"), F.col("refs.article_number").alias("qa"), F.col("refs.clause_number").alias("qc")).filter("number IS NOT NULL")
    named = chunks if "own_short" in chunks.columns else R.own_numbers(chunks)
    own = F.array_distinct(F.array("own_number", "own_short"))
    full = named.withColumn("number", F.explode(F.filter(own, lambda x: x != "")))
    hit = full.join(F.broadcast(q) if few else q, "number")
    kind = F.when((F.col("qa") != "") & (F.col("article") == F.col("qa")) & (F.col("qc") != "") & (F.col("clause") == F.col("qc")), "clause").when((F.col("qa") != "") & (F.col("article") == F.col("qa")), "article").when(F.col("qa") == "", "document")
    return hit.withColumn("match_type", kind).filter("match_type IS NOT NULL").select("qid", "chunk_id", "doc_id", "match_type")
