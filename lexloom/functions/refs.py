"""References to laws in queries and documents: column expressions over text.

The parser's contract is the engine's own where only uses of it are known:
numbers keep slashes, letters are upper-case ASCII with đ as D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Roman numerals of chapters (fixed values by their rule: position is value).
ROMANS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]


def document_number(x: Column) -> Column:
    """Upper-case ASCII without spaces."""
    return F.regexp_replace(F.upper(T.fold(F.coalesce(x, F.lit("")))), r"\s+", "")


def _short(number: Column) -> Column:
    return F.regexp_extract(number, r"^(\d+/\d{2,4})", 1)


def short_number(x: Column) -> Column:
    return _short(document_number(x))


def own_numbers(rows: DataFrame) -> DataFrame:
    """Rows with ``own_number`` and ``own_short`` of their document_number, which is normalised once for both."""
    return rows.withColumn("own_number", document_number(F.col("document_number"))).withColumn("own_short", _short(F.col("own_number")))


def numeric_ref(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d+)", 1)


def chapter_ref(x: Column) -> Column:
    """Arabic digits of a chapter given in Roman or Arabic form."""
    roman = F.upper(F.regexp_extract(F.upper(T.fold(x)), r"\b([IVXLC]+|\d+)\s*$", 1))
    out = F.when(roman.rlike(r"^\d+$"), roman)
    for value, name in enumerate(ROMANS, 1):
        out = out.when(roman == name, str(value))
    return F.coalesce(out, F.lit(""))


def legal_refs(query: Column) -> Column:
    """document_number, document_short, document_loose, article_number, clause_number, chapter, law_name; empty where absent."""
    up, low = F.upper(T.fold(query)), T.ascii_normal(query)
    number = F.regexp_extract(up, r"\b(\d+/\d{4}/[A-Z0-9]+(?:-[A-Z0-9]+)*)", 1)
    loose = F.regexp_extract(up, r"\b(\d+/[A-Z]{2,}(?:-[A-Z]+)*)", 1)
    short = F.regexp_extract(up, r"(?<!\d)(\d+/\d{4})(?!\d)", 1)
    law = F.regexp_replace(F.regexp_extract(low, r"\b((?:bo luat|luat)\s+[a-z][a-z ]*[a-z])", 1), r"\s(?:la gi|quy dinh|co|ve)\b.*$", "")
    return F.struct(
        document_number(number).alias("document_number"), short.alias("document_short"), F.when(number == "", document_number(loose)).otherwise("").alias("document_loose"),
        F.regexp_extract(low, r"\bdieu\s+(\d+[a-z]?)\b", 1).alias("article_number"), F.regexp_extract(low, r"\bkhoan\s+(\d+)\b", 1).alias("clause_number"),
        chapter_ref(F.regexp_extract(low, r"\b(chuong\s+(?:[ivxlc]+|\d+))\b", 1)).alias("chapter"), F.trim(law).alias("law_name"),
    )


def extracted_number(x: Column) -> Column:
    """A document's own number: after the label ``Số``, else the first number of the usual form."""
    form = r"\d+/(?:\d{4}/)?[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*"
    first, second = F.regexp_extract(x, rf"(?iu)số\s*:?\s*({form})", 1), F.regexp_extract(x, rf"\b({form})", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def inferred_number(body: Column, title: Column, url: Column) -> Column:
    """From the body's label, else the title's ``n/...``, else the URL's slug."""
    slug = F.regexp_extract(url, r"(\d+-\d{4}-[a-z0-9]+(?:-[a-z]+)*)", 1)
    from_url = F.upper(F.regexp_replace(slug, r"^(\d+)-(\d{4})-", "$1/$2/"))
    return F.coalesce(
        F.nullif(F.regexp_extract(body, r"(?iu)số:\s*([0-9]+[^\s,;]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract(title, r"(?U)(\d+/[\w/-]+)", 1), F.lit("")), F.nullif(from_url, F.lit("")),
    )


#: Document types by how a file's name begins; two by what it contains, the first before and the last after these (fixed values).
FILE_TYPES = [(("nghi-dinh-", "nd-", "nd="), "Nghị định"), (("nghi-quyet-", "nq-"), "Nghị quyết"), (("thong-tu-", "tt-"), "Thông tư"), (("quyet-dinh-", "qd-"), "Quyết định")]
#: Document types by a line of their own (fixed values, in their order).
LINE_TYPES = [
    (r"HIẾN\s*PHÁP", "Hiến pháp"), (r"BỘ\s*LUẬT", "Bộ luật"), (r"LUẬT", "Luật"), (r"NGHỊ\s*QUYẾT", "Nghị quyết"), (r"NGHỊ\s*ĐỊNH", "Nghị định"), (r"QUYẾT\s*ĐỊNH", "Quyết định"),
    (r"THÔNG\s*TƯ", "Thông tư"), (r"CHỈ\s*THỊ", "Chỉ thị"), (r"CÔNG\s*VĂN", "Công văn"),
]
DEFAULT_TYPE = "Văn bản QPPL"


def document_type(content: Column, file_name: Column) -> Column:
    """By file name, else by the first line of a type alone (at most 30 characters) among 40, else the default."""
    name = F.lower(F.coalesce(file_name, F.lit("")))
    out = F.when(F.contains(name, F.lit("hien-phap")), "Hiến pháp")
    for heads, t in FILE_TYPES:
        out = out.when(F.greatest(*(name.startswith(h) for h in heads), F.lit(False)), t)
    out = out.when(F.contains(name, F.lit("luat")), "Luật")
    lines = F.transform(F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, 40), lambda s: F.upper(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
    every = "|".join(p for p, _ in LINE_TYPES)
    first = F.try_element_at(F.filter(lines, lambda s: (F.length(s) <= 30) & s.rlike(f"(?U)^(?:{every})$")), F.lit(1))
    for p, t in LINE_TYPES:
        out = out.when(first.rlike(f"(?U)^{p}$"), t)
    return out.otherwise(DEFAULT_TYPE)


#: Issuers named in the head, after the two that come before the foot (fixed values, in their order).
HEAD_ISSUERS = [
    (r"CHÍNH\s*PHỦ", "Chính phủ"), (r"THỦ\s*TƯỚNG\s*CHÍNH\s*PHỦ", "Thủ tướng Chính phủ"), (r"BỘ\s*NỘI\s*VỤ", "Bộ Nội vụ"), (r"BỘ\s*TRƯỞNG\s*BỘ\s*NỘI\s*VỤ", "Bộ trưởng Bộ Nội vụ"),
    (r"BAN\s*CHẤP\s*HÀNH\s*TRUNG\s*ƯƠNG", "Ban Chấp hành Trung ương"),
]


def issuer(content: Column) -> Column:
    """The parliament's committee, then parliament, in the head (3,000 characters); then the foot (2,000); then the head's others."""
    head, foot = F.upper(F.substring(content, 1, 3000)), F.upper(F.right(content, F.lit(2000)))
    out = (
        F.when(head.rlike(r"(?U)ỦY\s*BAN\s*THƯỜNG\s*VỤ\s*QUỐC\s*HỘI"), "Ủy ban Thường vụ Quốc hội").when(head.rlike(r"(?U)QUỐC\s*HỘI"), "Quốc hội")
        .when(F.contains(foot, F.lit("THỦ TƯỚNG")), "Chính phủ").when(F.contains(foot, F.lit("BỘ NỘI VỤ")), "Bộ Nội vụ")
    )
    for p, name in HEAD_ISSUERS:
        out = out.when(head.rlike(f"(?U){p}"), name)
    return out.otherwise("")


def iso_date(x: Column, effective: bool = False) -> Column:
    """``ngày D tháng M năm Y`` as YYYY-MM-DD: the issue date in the head, or the date of effect in the tail."""
    pattern = r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    part = F.right(x, F.lit(5000)) if effective else F.substring(x, 1, 3000)
    full = (r"(?iu)hiệu lực[^.]{0,80}?" if effective else "(?iu)") + pattern
    d, m, y = (F.regexp_extract(part, full, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


#: Head words of a title page (fixed values).
TITLE_HEADS = r"(HIẾN\s*PHÁP|BỘ\s*LUẬT|\bLUẬT\b|NGHỊ\s*QUYẾT|NGHỊ\s*ĐỊNH|QUYẾT\s*ĐỊNH|THÔNG\s*TƯ|CHỈ\s*THỊ|CÔNG\s*VĂN)"


def extracted_title(content: Column, doc_type: Column, number: Column) -> Column:
    """The capital lines from a short line with the document's type on, up to the first other one, among 50 lines; else type and number.

    A line is capital if it has no small letter, or over half of it (and more
    than 5 characters) are capitals; blank lines end a title that has begun.
    """
    lines = F.transform(F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, 50), lambda x: F.trim(x))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("title"))  # 0 before the head line, 1 after it, 2 done

    def capitals(x: Column) -> Column:
        return F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))

    def add(s: Column, x: Column) -> Column:
        at = F.when((s["at"] == 0) & (F.length(x) < 30) & F.upper(x).rlike(f"(?U){TITLE_HEADS}"), 1).otherwise(s["at"])
        big = ((x == F.upper(x)) & (capitals(x) > 0)) | ((F.length(x) > 5) & (capitals(x) > F.length(x) * 0.5))
        take = (at == 1) & (x != "") & big
        done = (at == 1) & ~take & (F.size(s["title"]) > 0)
        return F.struct(F.when(done, 2).otherwise(at).alias("at"), F.when(take, F.array_append(s["title"], x)).otherwise(s["title"]).alias("title"))

    joined = F.regexp_replace(F.array_join(F.aggregate(lines, state, add)["title"], " "), r"\s+", " ")
    named = F.when((F.coalesce(doc_type, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != ""), F.concat_ws(" ", doc_type, number)).otherwise("")
    return F.when(joined == "", named).when(joined == F.upper(joined), F.initcap(joined)).otherwise(joined)


def leading_url(x: Column) -> Column:
    return F.regexp_extract(F.array_join(F.slice(F.split(x, "\n"), 1, 5), "\n"), r"(https?://\S+)", 1)


def without_appendix(x: Column, marker: str = "ENGLISH TRANSLATION") -> Column:
    """Cut at the marker if it stands after seven tenths of the text."""
    at = F.instr(x, marker)
    return F.when(at > F.length(x) * 0.7, F.rtrim(F.substring(x, F.lit(1), at - 1))).otherwise(x)


#: Sectors by their keywords (fixed values).
SECTORS = {
    "Cán bộ, công chức": ["cán bộ", "công chức", "tuyển dụng công chức", "biên chế"], "Viên chức": ["viên chức"], "Tổ chức bộ máy": ["tổ chức bộ máy", "tổ chức chính phủ", "cơ cấu tổ chức"],
    "Chính quyền địa phương": ["chính quyền địa phương", "hội đồng nhân dân", "ủy ban nhân dân", "đơn vị hành chính"], "Thi đua, khen thưởng": ["thi đua", "khen thưởng", "huân chương", "danh hiệu"],
    "Tiền lương": ["tiền lương", "lương cơ sở", "phụ cấp", "hệ số lương"], "Tôn giáo, tín ngưỡng": ["tôn giáo", "tín ngưỡng", "nhà thờ", "chùa"], "Văn thư, lưu trữ": ["văn thư", "lưu trữ", "tài liệu"],
    "Thanh niên": ["thanh niên", "tuổi trẻ"], "Bảo hiểm xã hội": ["bảo hiểm xã hội", "bhxh", "bảo hiểm y tế"], "Dân chủ cơ sở": ["dân chủ cơ sở", "dân chủ ở cơ sở"],
    "Cải cách hành chính": ["cải cách hành chính", "thủ tục hành chính"], "Hội, tổ chức phi chính phủ": ["hội", "tổ chức phi chính phủ", "tổ chức xã hội"], "Thanh tra": ["thanh tra"], "Người có công": ["người có công", "thương binh", "liệt sĩ"],
}
DEFAULT_SECTOR = "Nội vụ (chung)"


def sectors(x: Column, url: Column, labels: dict[str, list[str]] | None = None, default: str = DEFAULT_SECTOR) -> Column:
    """Sorted labels of which a keyword is in the lower-cased text, or hyphenated in the URL."""
    labels = SECTORS if labels is None else labels
    low, slug = F.lower(F.coalesce(x, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    tests = [
        F.when(F.greatest(*[F.contains(low, F.lit(k)) | F.contains(slug, F.lit(k.replace(" ", "-"))) for k in keys], F.lit(False)), F.lit(label))
        for label, keys in labels.items()
    ]
    found = F.array_sort(F.array_compact(F.array(*tests)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def answer_citations(x: Column, limit: int = 10) -> Column:
    """Distinct citations of articles and document numbers in an answer, without regard to case."""
    a = F.regexp_extract_all(x, F.lit(r"(?iu)((?:khoản\s+\d+\s+)?điều\s+\d+[a-zđ]?)"), F.lit(1))
    b = F.regexp_extract_all(x, F.lit(r"(?iu)(\d+/\d{4}/[A-ZĐ0-9-]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(F.concat(a, b), lambda v: F.lower(v))), 1, limit)


def context_citations(titles: Column, limit: int = 5) -> Column:
    """Distinct citations of contexts in order, with regard to case; blank ones are none."""
    return F.slice(F.array_distinct(F.filter(F.transform(titles, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")), 1, limit)


def reference_numbers(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(T.fold(x)), F.lit(r"\b(\d+[a-z]?)\b"), F.lit(1))


def plan_rows(plan: Column, per_page: int = 20) -> Column:
    """``docs,url;...`` as an array of (org, docs, pages)."""
    parts = F.filter(F.split(plan, ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(
        F.parse_url(F.trim(F.element_at(F.split(p, ","), 2)), F.lit("QUERY"), F.lit("org")).alias("org"), F.trim(F.element_at(F.split(p, ","), 1)).cast("int").alias("docs"),
        F.ceil(F.trim(F.element_at(F.split(p, ","), 1)).cast("int") / F.lit(per_page)).cast("int").alias("pages"),
    ))
