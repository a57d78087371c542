"""Evaluation: matches of cases and hits, ranks, summaries, latency percentiles, labels, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.functions import text as T

ROUTES = ["structured_exact", "narrow_bm25", "law_anchored_hybrid", "hybrid_default"]


def percentile_cut(x: Column, p: float) -> Column:
    """Linear interpolation, cut to an integer; 0 without values."""
    return F.coalesce(F.percentile(x, F.lit(p)).cast("long"), F.lit(0).cast("long"))


def percentile_round(x: Column, p: float) -> Column:
    """Linear interpolation, rounded half to even."""
    return F.coalesce(F.bround(F.percentile(x, F.lit(p))).cast("long"), F.lit(0).cast("long"))


def latency_stats(df: DataFrame, ms: str, *by: str) -> DataFrame:
    x = F.col(ms)
    return df.groupBy(*by).agg(F.bround(F.avg(x)).cast("long").alias("avg_ms"), percentile_round(x, 0.5).alias("p50"), percentile_round(x, 0.95).alias("p95"), percentile_round(x, 0.99).alias("p99"), F.max(x).cast("long").alias("max_ms"))


def eval_summary(results: DataFrame, *by: str) -> DataFrame:
    """Recall at 5 and 10 (null and 0 fall back to the source hit), MRR, rates and latency; an empty table gives zeros."""

    def rate(test: Column) -> Column:
        return F.coalesce(F.round(F.count_if(test) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0))

    def hit(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col("hit_expected_source"), F.lit(0)) == 1

    rank = F.col("rank_of_first_correct")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), rate(hit("hit_top5")).alias("recall_at_5"), rate(hit("hit_top10")).alias("recall_at_10"),
        F.coalesce(F.round(F.sum(F.when(rank >= 1, 1 / rank).otherwise(0.0)) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("mrr"),
        rate(F.col("citation_correct") == 1).alias("citation_accuracy"), rate(F.col("grounded") == 1).alias("grounded_rate"), rate(F.col("hallucination") == 1).alias("hallucination_rate"),
        F.coalesce(F.avg("total_latency_ms").cast("long"), F.lit(0).cast("long")).alias("latency_avg"), percentile_cut(F.col("total_latency_ms"), 0.5).alias("latency_p50"), percentile_cut(F.col("total_latency_ms"), 0.95).alias("latency_p95"),
    )


def case_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each case with whether they hold the expected document or article: contained texts, within the case's own hits."""
    j = hits.join(cases, "case_id")
    doc, art = T.match_normal(F.col("expected_doc_id")), T.match_normal(F.col("expected_article_ref"))
    hay = T.match_normal(F.concat_ws(" ", "doc_id", "title", "document_number"))
    ref = T.match_normal(F.concat_ws(" ", "article", "clause", "path"))
    return j.withColumn("doc_ok", (doc != "") & F.contains(hay, doc)).withColumn("article_ok", (art != "") & F.contains(ref, art)).withColumn("ok", F.when((doc != "") & (art != ""), F.col("doc_ok") & F.col("article_ok")).when(doc != "", F.col("doc_ok")).otherwise(F.col("article_ok")))


def first_ranks(matched: DataFrame, key: str = "case_id") -> DataFrame:
    """Rank (from 1) of the first right hit and hits within 5 and 10."""
    ok = F.when(F.col("ok"), F.col("rank"))
    return matched.groupBy(key).agg((F.min(ok) + 1).alias("rank_of_first_correct"), F.max(F.when((F.col("rank") < 5) & F.col("ok"), 1).otherwise(0)).alias("hit_top5"), F.max(F.when((F.col("rank") < 10) & F.col("ok"), 1).otherwise(0)).alias("hit_top10"))


def hit_quality(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case the ranks (from 1, among the first ten) of the first hit of the document, family, article, focus and topic, and the flags that follow.

    ``cases`` holds (case_id, expected_route, expected_doc_id,
    expected_doc_number, expected_family, expected_article, expected_clause,
    focus_terms), empty where nothing is expected; ``hits`` (case_id, rank from
    0, doc_id, document_number, family, title, path, article, clause, text).
    """
    c, empty = F.col, F.lit("")
    norm = lambda x: T.match_normal(x.cast("string"))
    number = lambda x: R.document_number(x.cast("string"))
    j = hits.filter("rank < 10").join(cases, "case_id")
    texts = [F.coalesce(c(x).cast("string"), empty) for x in ("doc_id", "document_number", "title", "path")]
    want = number(c("expected_doc_number"))
    doc = ((norm(c("expected_doc_id")) != "") & (norm(c("expected_doc_id")) == norm(c("doc_id")))) | ((want != "") & F.contains(number(F.concat_ws(" ", *texts)), want))
    unit = lambda value, word: F.coalesce(F.nullif(F.regexp_extract(F.lower(F.coalesce(c(value).cast("string"), empty)), r"(\d+[a-z]?)", 1), empty), F.regexp_extract(T.ascii_normal(F.coalesce(c("path"), empty)), rf"\b{word}\s+(\d+[a-z]?)\b", 1))
    article = (norm(c("expected_article")) != "") & (unit("article", "dieu") == norm(c("expected_article"))) & ((norm(c("expected_clause")) == "") | (unit("clause", "khoan") == norm(c("expected_clause"))))
    hay = T.ascii_tokens(F.concat_ws(" ", *(F.coalesce(c(x).cast("string"), empty) for x in ("title", "path", "article", "clause")), F.coalesce(F.substring("text", 1, 1200), empty)))
    matched = F.size(F.filter("focus_terms", lambda t: F.array_contains(F.col("_hay"), t)))
    j = j.withColumn("_hay", hay).withColumns({"_doc": doc, "_family": T.family_match(F.coalesce("expected_family", empty), F.coalesce("family", empty)), "_article": article, "_n": matched})
    terms = F.size("focus_terms")
    topical, focus = (terms > 0) & (c("_n") >= 1), (terms > 0) & (c("_n") >= F.when(terms >= 2, 2).otherwise(1))
    scoped = (c("expected_route") != "hybrid_default") & ((norm(c("expected_doc_id")) != "") | (want != ""))
    tests = {
        "law": c("_doc"), "family": c("_family"), "article": c("_doc") & c("_article"), "focus": focus & (~scoped | c("_doc")),
        "focus_within_family": F.when(c("_article"), c("_family")).otherwise(focus & c("_family")), "topical": topical,
    }
    first = F.col("rank") == 0
    grounded = first & ((F.trim(texts[0]) != "") | (F.trim(texts[1]) != "")) & ((F.trim(F.coalesce(c("article").cast("string"), empty)) != "") | (F.trim(texts[3]) != ""))
    per = j.groupBy("case_id").agg(*((F.min(F.when(t, c("rank"))) + 1).alias(f"rank_first_{n}") for n, t in tests.items()), F.max(grounded.cast("int")).alias("answer_grounded"))
    out = cases.select("case_id", "expected_route", norm(c("expected_article")).alias("_a"), terms.alias("_t")).join(per, "case_id", "left")
    out = out.withColumn("rank_first_family", F.coalesce("rank_first_family", "rank_first_law"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    default, by_article, by_focus = c("expected_route") == "hybrid_default", c("_a") != "", c("_t") > 0
    kind = lambda a, b, d, e: F.when(default, a).when(by_article, b).when(by_focus, d).otherwise(e)
    ranks = {n: c(f"rank_first_{n}") for n in tests}
    correct = kind(ranks["topical"].isNotNull(), ranks["article"].isNotNull(), ranks["focus"].isNotNull(), ranks["law"].isNotNull())
    top1 = kind(ranks["focus"] == 1, ranks["article"] == 1, ranks["focus"] == 1, ranks["law"] == 1)
    law = ranks["law"].isNotNull()
    return out.select(
        "case_id", "expected_route", *ranks.values(), flag(law).alias("correct_law_top10"), flag(ranks["family"].isNotNull()).alias("correct_family_top10"), flag(law).alias("law_found_top10"), flag(correct).alias("correct_article_top10"),
        flag(correct & law).alias("correct_article_top10_given_law_found"), flag(top1).alias("focus_top1"), flag(top1 & law).alias("focus_top1_given_law_found"), flag(ranks["focus"] <= 3).alias("focus_top3"),
        flag(ranks["focus_within_family"] == 1).alias("focus_top1_within_family"), flag(ranks["topical"].isNotNull()).alias("topical_doc_top10"), F.coalesce("answer_grounded", F.lit(0)).alias("answer_grounded"),
        flag(by_article).alias("article_case"), flag(by_focus).alias("focus_case"),
    )


#: Rates over all cases of a route, and rates over the cases that a flag names (fixed values).
RATES = ["correct_law_top10", "correct_family_top10", "correct_article_top10", "law_found_top10", "focus_top1", "focus_top3", "focus_top1_within_family", "topical_doc_top10", "answer_grounded"]
CONDITIONAL = {
    "correct_article_top10_given_law_found": ("correct_article_top10", "law_found_top10"), "focus_top1_given_law_found": ("focus_top1", "law_found_top10"), "correct_article_top10_on_article_cases": ("correct_article_top10", "article_case"),
    "focus_top1_on_focus_cases": ("focus_top1", "focus_case"), "focus_top3_on_focus_cases": ("focus_top3", "focus_case"),
}


def quality_rates(rows: DataFrame, by: str = "expected_route") -> DataFrame:
    """Per route: cases, the quality rates, and the rates among the cases that their condition leaves (0 without any)."""
    zero = lambda x: F.coalesce(F.round(x, 4), F.lit(0.0))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), *(zero(F.avg(c)).alias(f"{c}_rate") for c in RATES), *(zero(F.avg(F.when(F.col(when) == 1, F.col(c)))).alias(f"{n}_rate") for n, (c, when) in CONDITIONAL.items()))


def route_summary(rows: DataFrame, routes: list[str], rates: list[str], latency: str = "latency_ms") -> DataFrame:
    """Per route of a fixed list (zero rows too): cases, rates and latency."""
    base = rows.sparkSession.createDataFrame([(r,) for r in routes], "actual_route string")
    agg = rows.groupBy("actual_route").agg(F.count(F.lit(1)).alias("cases"), *(F.round(F.avg(c), 4).alias(c) for c in rates), percentile_round(F.col(latency), 0.5).alias("p50"), percentile_round(F.col(latency), 0.95).alias("p95"))
    return base.join(agg, "actual_route", "left").fillna(0)


def labels(tests: dict[str, Column]) -> tuple[Column, Column]:
    """Labels whose test holds, in order and once, and the primary one (PASS if none)."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(t, F.lit(n.rstrip("#"))) for n, t in tests.items()))))
    return found, F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise("PASS")


#: Routes on which a hit of the same family counts as an equivalent (fixed values).
SOFT_ROUTES = ("doc_scoped_hybrid_candidate_docs", "law_anchored_hybrid_loose", "law_anchored_hybrid", "hybrid_default")


def failure_tests() -> dict[str, Column]:
    """Tests over the benchmark row's columns, in the order in which labels are given; a label may stand twice, by a name with ``#``."""
    e, a, c = F.col("expected_route"), F.col("actual_route"), F.col
    exact, family = c("correct_law_top10") == 1, c("correct_family_top10") == 1
    tie = (e == "doc_scoped_hybrid_exact_doc") & (a == "doc_scoped_hybrid_candidate_docs") & exact & (c("selected_reason") == "candidate_low_margin_or_tie")
    promoted = (e == "law_anchored_hybrid_loose") & (a == "doc_scoped_hybrid_candidate_docs") & (exact | family) & (c("allowed_docs") >= 1)
    wrong, default = (e != "") & (a != e), e == "hybrid_default"
    scoped = e.isin("doc_scoped_hybrid_exact_doc", "doc_scoped_hybrid_candidate_docs")
    in_scope = a.startswith("doc_scoped_hybrid")
    topical, top1, top3, article = c("topical_doc_top10") == 1, c("focus_top1") == 1, c("focus_top3") == 1, c("correct_article_top10") == 1
    structured, soft = e == "structured_exact", e.isin(*SOFT_ROUTES) & family
    article_missed = ~default & exact & (c("expected_article") != "") & ~article
    return {
        "ROUTE_ACCEPTABLE_ALIAS_TIE": wrong & tie, "ROUTE_ACCEPTABLE_SCOPE_PROMOTION": wrong & ~tie & promoted, "ROUTE_WRONG": wrong & ~tie & ~promoted, "SCOPED_FILTER_BROKEN": c("scoped_filter_broken"),
        "PARSER_DOC_NUMBER_FAIL": e.isin("structured_exact", "narrow_bm25") & (c("expected_doc_number") != "") & ~c("has_doc_ref"),
        "PARSER_LAW_NAME_FAIL": (scoped | e.isin("law_anchored_hybrid_loose", "law_anchored_hybrid")) & ~c("has_law_name"),
        "DOC_LOOKUP_CONFIDENCE_TOO_LOW": scoped & (a == "law_anchored_hybrid_loose"), "DOC_LOOKUP_SCOPE_WRONG": scoped & in_scope & ~exact & ~family, "DOC_FAMILY_EQUIVALENT": scoped & in_scope & ~exact & family,
        "QUERY_TOO_VAGUE": default & c("query_too_vague"), "TOPICAL_FAMILY_EQUIVALENT": default & topical & ~exact & family, "TOPICAL_RETRIEVAL_OK_BUT_NOT_EXACT": default & topical & ~exact & ~family,
        "BM25_NOT_FOCUSED": default & ~topical & ~top3, "RERANK_BAD_TOP1": default & top3 & ~top1,
        "DOC_FAMILY_EQUIVALENT#": ~default & ~exact & soft, "LOOKUP_DOC_MISS": ~default & ~exact & ~soft & structured, "BM25_NOT_FOCUSED#": ~default & ~exact & ~soft & ~structured,
        "LOOKUP_ARTICLE_MISS": article_missed & structured, "BM25_NOT_FOCUSED##": article_missed & ~structured, "RERANK_BAD_TOP1#": ~default & exact & article & ~top1,
        "VECTOR_NOISE": ~top1 & ~c("vector_skipped") & exact & ~default,
    }


def mode_shares(rows: DataFrame, column: str = "primary_label") -> DataFrame:
    """(label, n, share) of the primary labels; acceptable promotions and passes are no true failures."""
    w = Window.partitionBy(F.lit(1))  # over the few labels
    per = rows.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("true_failure", ~F.col("label").startswith("ROUTE_ACCEPTABLE") & (F.col("label") != "PASS"))


def label_distribution(rows: DataFrame, column: str = "labels") -> DataFrame:
    return rows.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: Acceptance thresholds (fixed values).
GATES = {"law_top10": (">=", 0.40), "law_found_top10": (">=", 0.50), "topical_top10": (">=", 0.50), "focus_top1": (">=", 0.20), "grounded": (">=", 0.75), "p95_ms": ("<=", 5000.0), "vague_share": ("<", 0.70), "garbage_rate": ("<=", 0.50)}


def gates(metrics: DataFrame) -> DataFrame:
    """(metric, value) with threshold and whether it is met."""
    ok, at = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    for name, (op, limit) in GATES.items():
        v = F.col("value")
        ok = F.when(F.col("metric") == name, v >= limit if op == ">=" else v <= limit if op == "<=" else v < limit).otherwise(ok)
        at = F.when(F.col("metric") == name, F.lit(limit)).otherwise(at)
    return metrics.withColumn("threshold", at).withColumn("met", ok)


def metric_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.select("metric", F.col("value").alias("now")).join(before.select("metric", F.col("value").alias("before")), "metric", "full").withColumn("delta", F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4))


def generated_cases(docs: DataFrame, route: str, least: int) -> DataFrame:
    """Template cases of a route, by document in order: the template turns with the case's number."""
    w = Window.orderBy("doc_id")
    few = docs.orderBy("doc_id").limit(least).withColumn("idx", F.row_number().over(w) - 1)
    question = F.when(F.pmod("idx", F.lit(3)) == 0, F.format_string("Theo %s thì %s?", F.col("doc_id").cast("string"), F.col("focus"))).when(F.pmod("idx", F.lit(3)) == 1, F.format_string("Quy định %s tại %s", F.col("focus"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("focus"), F.lit(" ?")))
    return few.select(F.format_string(f"{route}_%04d", F.col("idx") + 1).alias("case_id"), F.lit(route).alias("route"), question.alias("question"), F.col("doc_id").cast("string").alias("expected_doc_id"))


def ablation(cases: DataFrame, switches: dict[str, tuple[bool, bool, bool]]) -> DataFrame:
    """Every variant of the switches for every case; the variants are a short fixed list."""
    v = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(a).alias("use_rewrite"), F.lit(b).alias("use_vector"), F.lit(c).alias("use_rerank")) for n, (a, b, c) in switches.items()))
    return cases.withColumn("v", F.explode(v)).select("*", "v.*").drop("v")


def route_counts(cases: DataFrame, minimum: dict[str, int]) -> DataFrame:
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv]), F.col("route")), F.lit(0))
    return cases.groupBy("route").agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= need)
