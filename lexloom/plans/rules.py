"""Registered queries that walk through every import rule and every concept rule, on texts that the documents fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.operators import rewrite as Q
from lexloom.plans.catalog import texts
from lexloom.plans.registry import query

FILES = ["hien-phap-2013", "nghi-dinh-12", "nd-12", "nd=12", "nghi-quyet-3", "nq-3", "thong-tu-4", "tt-4", "quyet-dinh-5", "qd-5", "bo-luat-dat-dai", "van-ban", "a-nd-12"]
LINES = ["HIẾN PHÁP", "Bộ luật", "  luật  ", "NGHỊ  QUYẾT", "NGHỊ ĐỊNH", "Quyết định", "THÔNG TƯ", "CHỈ THỊ", "CÔNG VĂN", "NGHỊ ĐỊNH VỀ ĐẤT", "", "LUẬT QUY ĐỊNH CHI TIẾT THI HÀNH MỘT SỐ ĐIỀU"]
HEADS = ["ỦY BAN THƯỜNG VỤ QUỐC HỘI", "Quốc  hội", "CHÍNH PHỦ", "THỦ TƯỚNG CHÍNH PHỦ", "BỘ NỘI VỤ", "BỘ TRƯỞNG BỘ NỘI VỤ", "BAN CHẤP HÀNH TRUNG ƯƠNG", ""]
FEET = ["", "KT. THỦ TƯỚNG", "", "BỘ TRƯỞNG BỘ NỘI VỤ", ""]
WORDS = ["", *(keys[0] for keys in R.SECTORS.values()), "bhxh", "cơ cấu tổ chức"]
SLUGS = ["x/thanh-tra-so", "x/y", "nguoi-co-cong", "x/cán-bộ"]


def _sql(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _pick(items: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, items)), (i % len(items) + 1).cast("int"))


def _cases(pairs: list[tuple[str, str]], subject: str) -> str:
    return " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{v}'" for p, v in pairs)


_LINE = "|".join(p for p, _ in R.LINE_TYPES)
IMPORT_SQL = f"""WITH x AS (SELECT doc_id, {_sql(FILES)}[doc_id % {len(FILES)} + 1] AS name, {_sql(SLUGS)}[doc_id % {len(SLUGS)} + 1] AS url,
{_sql(HEADS)}[doc_id % {len(HEADS)} + 1] || chr(10) || {_sql(LINES)}[doc_id % {len(LINES)} + 1] || chr(10) || {_sql(WORDS)}[doc_id % {len(WORDS)} + 1] || chr(10) || coalesce(text, '') || chr(10) || {_sql(FEET)}[doc_id % {len(FEET)} + 1] AS c FROM documents),
y AS (SELECT *, upper(c[1:3000]) AS head, upper(right(c, 2000)) AS foot, list_filter(list_transform(string_split(c, chr(10))[1:40], lambda s: upper(trim(s))), lambda s: length(s) <= 30 AND regexp_full_match(s, '{_LINE}'))[1] AS line FROM x)
SELECT doc_id, CASE WHEN contains(name, 'hien-phap') THEN 'Hiến pháp' WHEN regexp_matches(name, '^(nghi-dinh-|nd-|nd=)') THEN 'Nghị định' WHEN regexp_matches(name, '^(nghi-quyet-|nq-)') THEN 'Nghị quyết' WHEN regexp_matches(name, '^(thong-tu-|tt-)') THEN 'Thông tư' WHEN regexp_matches(name, '^(quyet-dinh-|qd-)') THEN 'Quyết định' WHEN contains(name, 'luat') THEN 'Luật'
{_cases([(f"^({p})$", v) for p, v in R.LINE_TYPES], "line")} ELSE 'Văn bản QPPL' END AS doc_type,
CASE WHEN regexp_matches(head, 'ỦY\\s*BAN\\s*THƯỜNG\\s*VỤ\\s*QUỐC\\s*HỘI') THEN 'Ủy ban Thường vụ Quốc hội' WHEN regexp_matches(head, 'QUỐC\\s*HỘI') THEN 'Quốc hội' WHEN contains(foot, 'THỦ TƯỚNG') THEN 'Chính phủ' WHEN contains(foot, 'BỘ NỘI VỤ') THEN 'Bộ Nội vụ' {_cases(R.HEAD_ISSUERS, "head")} ELSE '' END AS issuer,
coalesce(nullif(array_to_string(list_sort(list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(lower(c), '{k}') OR contains(url, '{k.replace(' ', '-')}')" for k in keys) + f" THEN '{label}' END" for label, keys in R.SECTORS.items())}], lambda v: v IS NOT NULL)), '|'), ''), 'Nội vụ (chung)') AS sectors FROM y"""


@query("import_rules", IMPORT_SQL)
def import_rules(spark, d):
    """Type by every file name and line, issuer by every head and foot, sectors by every label."""
    i, n = F.col("doc_id"), F.lit("\n")
    content = F.concat(_pick(HEADS, i), n, _pick(LINES, i), n, _pick(WORDS, i), n, F.coalesce("text", F.lit("")), n, _pick(FEET, i))
    rows = texts(spark, d).select("doc_id", _pick(FILES, i).alias("name"), _pick(SLUGS, i).alias("url"), content.alias("c"))
    return rows.select("doc_id", R.document_type(F.col("c"), F.col("name")).alias("doc_type"), R.issuer(F.col("c")).alias("issuer"), F.array_join(R.sectors(F.col("c"), F.col("url")), "|").alias("sectors"))


ASKED = sorted({x for ps in Q.CONCEPT_PHRASES.values() for x in ps} | {e for _, _, es, _ in Q.CONCEPT_RULES for e in es} | {"hieu luc khi nao", "thoi han giai quyet"})
_TAGS = [*(("regexp_matches(c, '" + p + "')", tag) for tag, p, _, _ in Q.CONCEPT_RULES), *(("(" + " OR ".join(f"contains(c, '{x}')" for x in ps) + ")", tag) for tag, ps in Q.CONCEPT_PHRASES.items())]
CONCEPT_SQL = f"""WITH x AS (SELECT doc_id, {_sql(ASKED)}[doc_id % {len(ASKED)} + 1] || ' ' || lower(coalesce(source, '')) AS c FROM documents), y AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {test} THEN '{tag}' END" for test, tag in _TAGS)}], lambda v: v IS NOT NULL) AS tags FROM x)
SELECT doc_id, array_to_string(list_filter(tags, lambda v, i: list_position(tags, v) = i), ',') AS tags FROM y"""


@query("concept_rules", CONCEPT_SQL)
def concept_rules(spark, d):
    """Concept tags of questions that hold every phrase and every expansion of every rule, in the rules' order."""
    asked = texts(spark, d).select("doc_id", F.concat_ws(" ", _pick(ASKED, F.col("doc_id")), F.lower(F.coalesce("source", F.lit("")))).alias("query"))
    return Q.concepts(asked.withColumn("clean", F.col("query"))).select("doc_id", F.array_join("concept_tags", ",").alias("tags"))
