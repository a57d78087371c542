"""Building a corpus: filters, joins of metadata and content, merges, statistics and page fields."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

MIN_LENGTH, MIN_CRAWL = 50, 100
#: Sectors, issuers, title words and document types of the domain filter (fixed values).
SECTORS = [
    "bộ máy hành chính", "lao động", "tiền lương", "cán bộ", "công chức", "viên chức", "bảo hiểm", "việc làm", "thi đua", "khen thưởng", "tôn giáo", "tín ngưỡng",
    "lưu trữ", "văn thư", "thanh niên", "dân chủ", "người có công", "biên chế", "chính quyền địa phương", "đơn vị hành chính", "địa giới",
]
ISSUERS = ["quốc hội", "chính phủ", "thủ tướng", "bộ nội vụ", "bộ lao động", "bộ tài chính", "bảo hiểm xã hội"]
TITLES = [
    "công chức", "viên chức", "cán bộ", "biên chế", "tiền lương", "lương cơ sở", "phụ cấp", "thi đua", "khen thưởng", "huân chương", "tôn giáo", "tín ngưỡng",
    "lưu trữ", "văn thư", "thanh niên", "bảo hiểm xã hội", "hưu trí", "bộ nội vụ", "chính quyền địa phương", "đơn vị hành chính", "dân chủ cơ sở", "người có công",
    "tai nạn lao động", "bệnh nghề nghiệp", "cải cách hành chính", "vị trí việc làm", "tuyển dụng công chức", "kỷ luật cán bộ", "đào tạo bồi dưỡng",
]
TYPES = ["Hiến pháp", "Luật", "Bộ luật", "Nghị quyết", "Nghị định", "Quyết định", "Thông tư", "Thông tư liên tịch", "Chỉ thị", "Lệnh", "Pháp lệnh"]
CORE_SECTORS = [
    "bộ máy hành chính", "cán bộ", "công chức", "viên chức", "thi đua", "khen thưởng", "tổ chức sự nghiệp", "chính quyền địa phương", "tôn giáo", "tín ngưỡng",
    "văn thư", "lưu trữ", "biên chế", "dân vận",
]
UNKNOWN_STATUS = "Chưa rõ"


def alternation(words: list[str]) -> str:
    """A case-insensitive pattern of any of the words, each taken literally."""
    return "(?iu)" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def domain_tests(type_col: Column, sector: Column, issuer: Column, title: Column, types=TYPES, sectors=SECTORS, issuers=ISSUERS, titles=TITLES) -> dict[str, Column]:
    t = T.blank_literals(type_col)
    return {
        "type_ok": t.isin(*types) | (t == ""), "sector_ok": F.coalesce(sector, F.lit("")).rlike(alternation(sectors)),
        "issuer_ok": F.coalesce(issuer, F.lit("")).rlike(alternation(issuers)), "title_ok": F.coalesce(title, F.lit("")).rlike(alternation(titles)),
    }


def domain_filter(tests: dict[str, Column]) -> Column:
    return tests["type_ok"] & (tests["sector_ok"] | tests["issuer_ok"] | tests["title_ok"])


def filter_stats(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One pass: rows, removed by type, matched by each test, kept."""
    return df.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(~tests["type_ok"]).alias("removed_by_type"), F.count_if(tests["sector_ok"]).alias("by_sector"),
        F.count_if(tests["issuer_ok"]).alias("by_issuer"), F.count_if(tests["title_ok"]).alias("by_title"), F.count_if(domain_filter(tests)).alias("kept"),
    )


def crawl_filter(sectors: Column, title: Column, words: list[str], core: list[str] = CORE_SECTORS) -> Column:
    """A core sector in the sectors, else a topic word in the title."""
    s, t = F.lower(F.coalesce(sectors, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in core] + [F.contains(t, F.lit(w)) for w in words])


def build_documents(content: DataFrame, metadata: DataFrame) -> DataFrame:
    """Content with its metadata (kept without any; by id, else by the id as a number), cleaned; too short texts and empty ids go. Duplicate metadata ids are an error."""
    meta = metadata.withColumn("id", F.col("id").cast("string"))
    columns = [c for c in meta.columns if c != "id"]
    one = F.when(F.assert_true(F.count(F.lit(1)) == 1, "duplicate metadata id").isNull(), F.first(F.struct(*columns)))
    meta = meta.groupBy("id").agg(one.alias("m"))
    body = content.select(F.col("id").cast("string").alias("id"), "content").withColumn("number", F.col("id").try_cast("long").cast("string"))
    plain = F.coalesce(F.col("number") == F.col("id"), F.lit(True))
    same = body.filter(plain).join(meta, "id", "left").select("id", "content", "m")
    # An id like 007 is looked up as it is, then as the number it stands for; such ids are few.
    other = body.filter(~plain).join(meta, "id", "left").join(meta.select(F.col("id").alias("number"), F.col("m").alias("m2")), "number", "left")
    rows = same.unionByName(other.select("id", "content", F.coalesce("m", "m2").alias("m"))).select("id", "content", "m.*")
    out = rows.select(
        F.concat(F.lit("doc_"), "id").alias("doc_id"), T.safe_string(F.col("title")).alias("title"), T.safe_string(F.col("document_number")).alias("document_number"),
        T.safe_string(F.col("legal_type")).alias("doc_type"), T.safe_string(F.col("issuing_authority")).alias("issuer"), T.safe_string(F.col("issuance_date")).alias("issue_date"),
        T.parse_list(F.col("legal_sectors")).alias("legal_sectors"), T.parse_list(F.col("signers")).alias("signers"), T.safe_string(F.col("url")).alias("url"), T.clean_text(F.col("content")).alias("content"),
    )
    return out.filter((F.length("content") >= MIN_LENGTH) & (F.col("doc_id") != "doc_"))


def join_filtered(content: DataFrame, filtered: DataFrame, order: str = "content") -> DataFrame:
    """Filtered metadata with its content, one row for each id: the first by ``order`` of those that are long enough."""
    rows = content.withColumn("id", F.col("id").cast("string")).filter(F.length("content") >= MIN_LENGTH)
    others = [c for c in rows.columns if c != "id"]
    wanted = filtered.withColumn("id", F.col("id").cast("string"))
    first = rows.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*others), F.struct(order, "content")).alias("c"))
    return first.select("id", *(F.col(f"c.{c}") for c in others)).join(wanted, "id")


def join_fallback(metadata: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents whose content stands in the metadata itself: every matched row of enough length, repeated ones too."""
    meta = matched.select(
        F.col("id").cast("string").alias("id"), *(T.safe_string(F.col(c)).alias(n) for c, n in (("title", "title"), ("document_number", "document_number"), ("legal_type", "doc_type"), ("issuing_authority", "issuer"), ("issuance_date", "issue_date"), ("url", "url"))),
    ).groupBy("id").agg(F.max_by(F.struct("title", "document_number", "doc_type", "issuer", "issue_date", "url"), F.struct("title", "url")).alias("m"))
    rows = metadata.select(F.col("id").cast("string").alias("id"), "content").filter(F.length("content") >= MIN_LENGTH)
    return rows.join(meta, "id").select(F.concat(F.lit("doc_"), "id").alias("doc_id"), "m.*", "content")


def join_crawl(content: DataFrame, matched: DataFrame) -> DataFrame:
    """The crawl set: content with the matched metadata as a nested ``meta``; status and date of effect are left to the crawl."""
    c = lambda name: T.clean_value(F.col(name))
    meta = F.struct(
        c("legal_type").alias("loai_van_ban"), c("document_number").alias("so_hieu"), c("issuing_authority").alias("co_quan"), c("signers").alias("nguoi_ky"), c("issuance_date").alias("ngay_ban_hanh"),
        c("legal_sectors").alias("linh_vuc"), F.lit(None).cast("string").alias("tinh_trang"), F.lit(None).cast("string").alias("ngay_hieu_luc"),
    )
    rows = matched.select(F.col("id").cast("string").alias("id"), c("document_number").alias("document_number"), c("title").alias("title"), c("url").alias("url"), meta.alias("meta"))
    return content.select(F.col("id").cast("string").alias("id"), T.clean_value(F.col("content")).alias("content")).join(rows, "id").select("document_number", "title", "url", "content", "meta")


def exact_samples(chunks: DataFrame, targets: DataFrame, order: str = "chunk_id") -> DataFrame:
    """The first chunk of each target (doc_id, article, clause): of that unit, or any of the article where the target names no clause."""
    own = targets.select("doc_id", "article", "clause").distinct()
    rows = chunks.select("doc_id", F.coalesce("article", F.lit("")).alias("article"), F.coalesce("clause", F.lit("")).alias("_clause"), F.col(order).alias("_order"))
    hit = rows.join(own, ["doc_id", "article"]).filter((F.col("clause") == F.col("_clause")) | (F.col("clause") == ""))
    return hit.groupBy("doc_id", "article", "clause").agg(F.min("_order").alias(order))


def merge_known(rows: DataFrame, order: str = "file_order") -> tuple[DataFrame, DataFrame]:
    """One row for each document number (else URL): the first with a known status, else the first; and the count of conflicts."""
    key = F.coalesce(F.nullif(F.coalesce(F.col("document_number"), F.lit("")), F.lit("")), F.col("url"))
    unknown = (F.col("status") == UNKNOWN_STATUS).cast("int")  # null is not "unknown"
    w = Window.partitionBy("merge_key").orderBy(F.coalesce(unknown, F.lit(0)), order)
    out = rows.withColumn("merge_key", key).withColumn("_n", F.row_number().over(w))
    return out.filter("_n = 1").drop("_n"), out.agg(F.count_if(F.col("_n") > 1).alias("conflicts"))


def frequencies(df: DataFrame, column: Column, top: int | None = None) -> DataFrame:
    """(value, n) by falling count, ties by value; null and empty are ``unknown``."""
    out = df.groupBy(F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(length)).cast("long").alias("avg_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))


def token_bucket(n: Column) -> Column:
    return F.when(n < 50, "<50").when(n < 200, "50-200").when(n < 500, "200-500").when(n < 1024, "500-1024").otherwise(">1024")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("doc_id").agg(F.bool_or(F.col("article") != "").alias("structured"))
    a = per.agg(F.count_if("structured").alias("with_articles"), F.count_if(~F.col("structured")).alias("fallback"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_id").rlike(r"_dup\d+$")).alias("collisions"), F.bround(F.avg("token_count"), 1).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))
    return a.crossJoin(F.broadcast(b))  # one row each


def url_tests(url: Column) -> dict[str, Column]:
    return {
        "document_page": F.contains(url, F.lit("/van-ban/")) & F.contains(url, F.lit(".aspx")), "ends_aspx": url.endswith(".aspx"), "short": F.length(url) < 80,
        "non_ascii": url.rlike(r"[^\x20-\x7E]"), "category": F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), "/"), 2), F.lit("")), F.lit("")),
    }


def page_links(html: Column, base: str) -> Column:
    """Distinct normalised absolute links of a listing page in order of appearance."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    absolute = F.transform(hrefs, lambda h: F.when(h.rlike(r"^[a-z]+://"), h).when(h.startswith("/"), F.concat(F.lit(base.rstrip("/")), h)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), h)))
    return F.array_distinct(F.transform(absolute, lambda h: T.normal_url(h)))


# Where a page's title, content and metadata stand, what ends the content, and the labels of metadata rows.
TITLE_PLACES = ["h1", ".doc-title", ".title", "title"]
CONTENT_PLACES = ["div.content1 div.content1", "div.content1", ".box-content-vb", ".toan-van-container", "#toanvancontent", "article"]
META_PLACES = [".boxTTVB .item", ".right-col p", ".ttvb .item"]
CONTENT_ENDS = ["Luu tru\nGhi chu\nY kien", "Bai lien quan:", "Hoi dap phap luat", "Ban an lien quan", "Facebook\nEmail\nIn"]
META_LABELS = {
    "loai_van_ban": ["Loai van ban", "Loại văn bản"], "so_hieu": ["So hieu", "Số hiệu"], "co_quan": ["Co quan ban hanh", "Cơ quan ban hành"], "nguoi_ky": ["Nguoi ky", "Người ký"],
    "ngay_ban_hanh": ["Ngay ban hanh", "Ngày ban hành"], "ngay_hieu_luc": ["Ngay hieu luc", "Ngày hiệu lực"], "tinh_trang": ["Tinh trang", "Tình trạng"], "linh_vuc": ["Linh vuc", "Lĩnh vực"],
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Elements in document order, each as (tag, id, classes, parent, first text, last text): texts are kept once, whatever the nesting."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.open, self.texts = [], [], []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        self.elements.append([tag, named.get("id") or "", (named.get("class") or "").split(), self.open[-1] if self.open else -1, len(self.texts), None])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        if any(self.elements[k][0] == tag for k in self.open):
            while self.elements[k := self.open.pop()][0] != tag:
                self.elements[k][5] = len(self.texts)
            self.elements[k][5] = len(self.texts)

    def handle_data(self, data):
        if (self.open and self.elements[self.open[-1]][0] in ("script", "style")) or not data.strip():
            return
        self.texts.append(data.strip())

    def text(self, k: int) -> str:
        return " ".join(self.texts[self.elements[k][4] : self.elements[k][5]])

    def found(self, place: str) -> list[int]:
        """Elements of a place: ``tag``, ``.class``, ``#id``, ``tag.class``, or one of these inside another."""
        *outer, last = place.split()

        def fits(k: int, simple: str) -> bool:
            tag, name, classes = self.elements[k][:3]
            if simple.startswith("#"):
                return name == simple[1:]
            want, _, kind = simple.partition(".")
            return want in ("", tag) and (not kind or kind in classes)

        def inside(k: int) -> bool:
            while (k := self.elements[k][3]) >= 0:
                if fits(k, outer[0]):
                    return True
            return False

        return [k for k in range(len(self.elements)) if fits(k, last) and (not outer or inside(k))]


def read_page(html: str | None) -> tuple[str, str, dict[str, str]]:
    """Title (first place with a text), content (first text of over 200 characters, by place) and metadata of a raw page."""
    p = _Page()
    p.feed(html or "")
    p.close()
    for e in p.elements:
        e[5] = len(p.texts) if e[5] is None and e[0] not in VOID else e[5]
    title = next((t for place in TITLE_PLACES for k in p.found(place) if (t := " ".join(p.text(k).split()))), "")
    content = next((t for place in CONTENT_PLACES for k in p.found(place) if len(t := p.text(k)) > 200), "")
    for end in CONTENT_ENDS:
        if (at := content.find(end)) > 0:
            content = content[:at].rstrip()
    meta: dict[str, str] = {}
    for place in META_PLACES:
        for row in map(p.text, p.found(place)):
            for key, labels in META_LABELS.items():
                for label in labels:
                    if label in row and (value := row.replace(label, "").strip().lstrip(":").strip()):
                        meta[key] = value
        if meta:
            break
    return title, content, meta


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, meta) of raw HTML pages."""

    def go(batches):
        for pdf in batches:
            found = [read_page(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [f[0] for f in found], "content": [f[1] for f in found], "meta": [f[2] for f in found]})

    return pages.select("page_id", "html").mapInPandas(go, "page_id long, title string, content string, meta map<string,string>")


def interleave(cases: DataFrame, route: str = "route", order: str = "case_id") -> DataFrame:
    """Round-robin over routes: the n-th case (``turn``) of every route before the next; inside a turn routes go by name.

    Sorting by (turn, route) is the merged order; a position is the count of cases of earlier turns and, in its turn, of earlier routes.
    """
    return cases.withColumn("turn", F.row_number().over(Window.partitionBy(route).orderBy(order)) - 1).withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy(route)) - 1)


def integrity_totals(manifest: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """One row: manifest pages, those done, those missing."""
    both = manifest.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("pages"), F.count("_done").alias("done"), F.count_if(F.col("_done").isNull()).alias("missing"))


def missing_pages(manifest: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Manifest rows that were not done."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")
