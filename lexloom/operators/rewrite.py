"""Query rewriting over a frame of queries: phrases, concepts, topics, anchors, lexical and semantic texts.

Rule tables are data; a plan is a struct column, so a batch of any size is one
projection.  Everything works on the folded query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

# Filler phrases, repairs, phrase tables, concepts, priors.
FILLERS = ["quy dinh hien hanh", "quy dinh chung", "nhu the nao", "la gi", "trong thuc te", "khi ap dung thuc te", "cho toi biet", "tom tat", "mot cach ngan gon", "duoc xu ly nhu the nao", "nhung gi", "ra sao"]
REPAIRS = {
    r"\bnhiem\s+quyen\s+han\b": "nhiem vu quyen han", r"\btham\s+quyen\s+cong\b": "tham quyen", r"\bpham\s+chinh\b": "pham vi dieu chinh", r"\bbao\s+dam\s+toan\b": "bao dam an toan",
    r"\bquyen\s+nghia\s+ban\s+cong\s+chuc\b": "quyen va nghia vu co ban cua cong chuc", r"\bquyet\s+hieu\s+luc\b": "thoi diem hieu luc", r"\blap\s+kinh\b": "lap ke hoach",
}
AMBIGUOUS = r"\b(lap\s+quan\s+kinh|kiem\s+sat\s+giai|quyet\s+hieu\s+luc)\b"
UNSTABLE = ["lap quan", "quan kinh", "kiem sat", "sat giai", "cong chuc thanh"]
STRONG = [
    "don phuong cham dut hop dong", "dieu kien tuyen dung cong chuc", "tham quyen xu phat vi pham hanh chinh", "quyen va nghia vu co ban cua cong chuc", "nhiem vu quyen han",
    "pham vi dieu chinh", "doi tuong ap dung", "hieu luc thi hanh", "tham quyen", "dieu kien",
]
ENTITIES = ["cong chuc", "can bo", "vien chuc", "thanh tra", "nguoi lao dong", "nguoi su dung lao dong", "co quan", "to chuc", "ca nhan"]
PROCEDURES = ["dieu kien", "thu tuc", "thoi han", "trinh tu", "ho so", "tham quyen"]
ACTORS = ["cong chuc", "can bo", "vien chuc", "nguoi lao dong", "nguoi su dung lao dong", "co quan", "to chuc"]
ACTIONS = ["tham quyen xu phat", "xu phat vi pham hanh chinh", "don phuong cham dut", "dieu kien tuyen dung", "quyen va nghia vu", "nhiem vu quyen han", "trach nhiem", "hieu luc thi hanh"]
OBJECTS = ["hop dong lao dong", "vi pham hanh chinh", "cong viec", "ho so", "tro cap that nghiep", "bao hiem xa hoi", "tuyen dung"]
QUALIFIERS = ["hien nay", "co ban", "cu the", "khi nao", "truong hop", "thuc te"]
#: Concepts by pattern: tag, pattern, expansions, subclass (fixed values, in their order).
CONCEPT_RULES = [
    ("pham_vi_dieu_chinh", r"\bpham\s+vi\s+dieu\s+chinh\b", ["pham vi dieu chinh", "doi tuong ap dung", "ap dung doi voi", "dieu chinh cac hoat dong"], "concept_generic"),
    ("doi_tuong_ap_dung", r"\bdoi\s+tuong\s+ap\s+dung\b", ["doi tuong ap dung", "pham vi ap dung", "ap dung doi voi"], "concept_generic"),
    ("hieu_luc_thi_hanh", r"\b(?:thoi\s+diem\s+)?hieu\s+luc(?:\s+thi\s+hanh)?\b", ["co hieu luc", "hieu luc thi hanh", "ngay co hieu luc", "thoi diem co hieu luc"], "concept_generic"),
    ("trach_nhiem", r"\btrach\s+nhiem\b", ["trach nhiem cua", "co trach nhiem", "chiu trach nhiem", "nhiem vu quyen han"], "concept_generic"),
    ("nhiem_vu_quyen_han", r"\bnhiem\s+vu\s+quyen\s+han\b", ["nhiem vu quyen han", "quyen va nghia vu", "co trach nhiem"], "concept_generic"),
    ("quyen_va_nghia_vu", r"\bquyen\s+va\s+nghia\s+vu\b", ["quyen va nghia vu", "quyen cua", "nghia vu cua"], "concept_generic"),
    ("tham_quyen_xu_phat", r"\btham\s+quyen\s+xu\s+phat(?:\s+vi\s+pham\s+hanh\s+chinh)?\b", ["tham quyen xu phat", "xu phat vi pham hanh chinh", "nguoi co tham quyen", "quyet dinh xu phat"], "sanction_power"),
    ("xu_ly_ky_luat", r"\bxu\s+ly\s+ky\s+luat\b", ["xu ly ky luat", "hinh thuc ky luat", "trinh tu xu ly ky luat"], "subject_action"),
    ("dieu_kien_tuyen_dung", r"\bdieu\s+kien\s+tuyen\s+dung\b", ["dieu kien tuyen dung", "tieu chuan tuyen dung", "ho so tuyen dung"], "subject_action"),
    ("don_phuong_cham_dut_hop_dong", r"\bdon\s+phuong\s+cham\s+dut\s+hop\s+dong\b", ["don phuong cham dut hop dong", "truong hop cham dut hop dong", "thoi han bao truoc"], "subject_action"),
    ("trinh_tu_thu_tuc", r"\btrinh\s+tu\s+thu\s+tuc\b", ["trinh tu thu tuc", "ho so thu tuc", "co quan giai quyet"], "procedural"),
    ("thoi_han_giai_quyet", r"\bthoi\s+han\s+giai\s+quyet\b", ["thoi han giai quyet", "thoi han xu ly", "thoi han thuc hien"], "procedural"),
]
#: Concepts by any of their phrases, wherever it stands (fixed values, in their order).
CONCEPT_PHRASES = {
    "pham_vi_dieu_chinh": ["pham vi dieu chinh", "doi tuong ap dung", "ap dung doi voi", "pham vi ap dung"],
    "hieu_luc_thi_hanh": ["hieu luc", "hieu luc thi hanh", "co hieu luc", "thi hanh ke tu"],
    "trach_nhiem": ["trach nhiem", "chiu trach nhiem", "co trach nhiem"],
    "nhiem_vu_quyen_han": ["nhiem vu", "quyen han", "nhiem vu quyen han", "chuc nang nhiem vu quyen han"],
    "quyen_va_nghia_vu": ["quyen va nghia vu", "quyen loi va nghia vu", "nghia vu", "quyen"],
    "dieu_kien_tuyen_dung": ["dieu kien tuyen dung", "tieu chuan tuyen dung", "dieu kien du tuyen"],
    "xu_ly_ky_luat": ["xu ly ky luat", "bi ky luat", "hinh thuc ky luat", "truong hop bi ky luat"],
    "tham_quyen_xu_phat": ["tham quyen xu phat", "xu phat vi pham hanh chinh", "nguoi co tham quyen xu phat"],
    "don_phuong_cham_dut_hop_dong": ["don phuong cham dut", "cham dut hop dong", "duoc quyen don phuong cham dut"],
    "dieu_kien_huong": ["dieu kien huong", "duoc huong khi nao", "truong hop duoc huong"],
    "thu_tuc_ho_so": ["thu tuc", "ho so", "trinh tu", "thanh phan ho so"],
    "tham_quyen": ["tham quyen", "co quan co tham quyen", "quyet dinh boi ai"],
}
#: What a concept adds to the core, expanded and title texts (fixed values).
CONCEPT_TEXTS = {
    "pham_vi_dieu_chinh": (["pham vi dieu chinh"], ["pham vi dieu chinh", "doi tuong ap dung", "ap dung doi voi"], ["pham vi dieu chinh", "doi tuong ap dung"]),
    "hieu_luc_thi_hanh": (["hieu luc thi hanh"], ["hieu luc thi hanh", "co hieu luc ke tu", "thi hanh ke tu"], ["hieu luc thi hanh"]),
    "trach_nhiem": (["trach nhiem"], ["trach nhiem", "co trach nhiem", "chiu trach nhiem"], ["trach nhiem"]),
    "nhiem_vu_quyen_han": (["nhiem vu quyen han"], ["nhiem vu quyen han", "nhiem vu", "quyen han", "chuc nang nhiem vu quyen han"], ["nhiem vu quyen han"]),
    "quyen_va_nghia_vu": (["quyen va nghia vu"], ["quyen va nghia vu", "nghia vu", "quyen co ban", "nghia vu co ban"], ["quyen va nghia vu"]),
    "tham_quyen_xu_phat": (["tham quyen xu phat vi pham hanh chinh"], ["tham quyen xu phat", "xu phat vi pham hanh chinh", "nguoi co tham quyen xu phat"], ["xu phat vi pham hanh chinh", "tham quyen xu phat"]),
    "don_phuong_cham_dut_hop_dong": (["don phuong cham dut hop dong"], ["don phuong cham dut hop dong", "cham dut hop dong lao dong", "quyen don phuong cham dut"], ["cham dut hop dong", "don phuong cham dut hop dong"]),
    "dieu_kien_tuyen_dung": (["dieu kien tuyen dung"], ["dieu kien tuyen dung", "tieu chuan tuyen dung", "dieu kien du tuyen"], ["dieu kien tuyen dung", "tieu chuan tuyen dung"]),
    "xu_ly_ky_luat": (["xu ly ky luat"], ["xu ly ky luat", "hinh thuc ky luat", "truong hop bi ky luat"], ["xu ly ky luat", "hinh thuc ky luat"]),
    "dieu_kien_huong": (["dieu kien huong"], ["dieu kien huong", "duoc huong khi nao", "truong hop duoc huong"], ["dieu kien huong", "truong hop duoc huong"]),
    "thu_tuc_ho_so": (["thu tuc ho so"], ["thu tuc", "ho so", "trinh tu", "thanh phan ho so"], ["thu tuc", "ho so", "trinh tu"]),
    "tham_quyen": (["tham quyen"], ["tham quyen", "co quan co tham quyen", "quyet dinh boi ai"], ["tham quyen", "co quan co tham quyen"]),
}
TOPICS = {
    "labor": r"\b(lao dong|hop dong lao dong|nguoi lao dong)\b", "civil_service": r"\b(cong chuc|can bo|vien chuc|thanh tra)\b", "administrative_sanction": r"\b(xu phat|vi pham hanh chinh|tham quyen xu phat)\b",
    "social_insurance": r"\b(bao hiem xa hoi|tro cap that nghiep)\b", "banking": r"\b(ngan hang|tin dung|lai suat)\b",
}
TYPE_PRIORS = {
    "general_legal": ["bo_luat", "luat", "vbhn", "nghi_dinh", "thong_tu"], "labor": ["bo_luat", "luat", "vbhn", "nghi_dinh", "thong_tu"], "civil_service": ["luat", "vbhn", "bo_luat", "nghi_dinh", "thong_tu"],
    "administrative_sanction": ["luat", "vbhn", "nghi_dinh", "thong_tu"], "social_insurance": ["luat", "vbhn", "nghi_dinh", "thong_tu"], "banking": ["luat", "vbhn", "nghi_dinh", "thong_tu"],
}
LOCAL = r"\b(ubnd|hdnd|so|tinh|thanh pho|quan|huyen|xa|phuong)\b"
ANCHOR_RULES = [
    (r"cong chuc|can bo|vien chuc", ["can bo cong chuc", "cong chuc"]), (r"lao dong", ["lao dong", "hop dong lao dong"]),
    (r"xu phat|vi pham hanh chinh", ["xu ly vi pham hanh chinh", "xu phat vi pham hanh chinh"]), (r"bao hiem xa hoi", ["bao hiem xa hoi"]),
]
STOP = ["khi", "nhu", "the", "nao", "can", "nhung", "chung", "ap", "thuc", "te", "cho", "toi", "biet", "tom", "tat", "hien", "nay", "ra", "sao", "luu", "gi", "la", "ve", "quy", "dinh", "duoc", "theo", "cua", "va", "mot", "so"]
KEPT = ["dung", "co", "vu", "nghia", "quyen", "tuyen", "cong", "chuc", "lao", "dong", "hop", "tham", "pham", "vi", "hanh", "chinh", "an", "toan", "hieu", "luc", "trach", "nhiem", "thu", "tuc", "xet", "xu", "ly"]


def _array(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _of(tags: str, table: dict[str, list[str]]) -> Column:
    """The phrases of all tags of an array column, in order."""
    lookup = F.create_map(*[x for tag, p in table.items() for x in (F.lit(tag), _array(p))])
    return F.flatten(F.transform(F.filter(tags, lambda t: F.map_contains_key(lookup, t)), lambda t: F.element_at(lookup, t)))


def found(clean: Column, phrases: list[str]) -> Column:
    """Phrases of the table that stand in the query as whole words, in table order."""
    return F.filter(_array(phrases), lambda p: F.contains(F.concat(F.lit(" "), clean, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))


def cleaned(query: Column) -> Column:
    """Folded text without fillers and with known slips mended."""
    x = T.ascii_normal(query)
    for f in FILLERS:
        x = F.regexp_replace(x, rf"\b{f}\b", " ")
    for slip, right in REPAIRS.items():
        x = F.regexp_replace(x, slip, right)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def sanitised(tokens: Column) -> Column:
    """(tokens, flags): left to right without stop words, words of under three letters that are no numbers, repeated letters, repeats and unstable pairs; legal words always stay."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("flags"))

    def add(s: Column, t: Column) -> Column:
        kept, pair = s["kept"], F.concat_ws(" ", F.try_element_at(s["kept"], F.lit(-1)), t)
        legal = t.isin(*KEPT)
        flag = (
            F.when(t.isin(*STOP) & ~legal, F.concat(F.lit("blacklist:"), t)).when((F.length(t) < 3) & ~t.rlike(r"^\d+$") & ~legal, F.concat(F.lit("short:"), t))
            .when(t.rlike(r"^(.)\1{3,}$"), "junk_token").when(F.array_contains(kept, t), "").when((F.size(kept) > 0) & pair.isin(*UNSTABLE), F.concat(F.lit("unstable_bigram:"), pair))
        )
        return F.when(flag.isNull(), F.struct(F.array_append(kept, t).alias("kept"), s["flags"].alias("flags"))).otherwise(
            F.struct(kept.alias("kept"), F.when((flag == "") | F.array_contains(s["flags"], flag), s["flags"]).otherwise(F.array_append(s["flags"], flag)).alias("flags"))
        )

    return F.aggregate(tokens, start, add)


def concepts(queries: DataFrame) -> DataFrame:
    """(clean, ...) with ``concept_tags``, by pattern and then by phrase, and ``concept_phrases``; strong phrases stand in ``clean``."""
    clean = F.col("clean")
    by_rule = F.array_compact(F.array(*(F.when(clean.rlike(p), F.lit(tag)) for tag, p, _, _ in CONCEPT_RULES)))
    by_phrase = F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(clean, F.lit(x)) for x in ps), F.lit(False)), F.lit(tag)) for tag, ps in CONCEPT_PHRASES.items())))
    out = queries.withColumns({"_rules": by_rule, "concept_tags": F.array_distinct(F.concat(by_rule, by_phrase))})
    expansions = _of("_rules", {tag: e for tag, _, e, _ in CONCEPT_RULES})
    return out.withColumn("concept_phrases", F.array_distinct(F.concat(expansions, _of("concept_tags", CONCEPT_PHRASES)))).withColumn("_expansions", F.array_distinct(expansions)).drop("_rules")


def rewrite(queries: DataFrame, query: str = "query") -> DataFrame:
    """The frame with its plan's columns: phrases, concepts, topic, anchors, texts, weakness, vagueness, confidence."""
    clean = F.col("clean")
    out = queries.withColumn("ascii", T.ascii_normal(F.col(query))).withColumn("clean", cleaned(F.col(query)))
    tables = {"strong_phrases": STRONG, "entity_phrases": ENTITIES, "procedural_phrases": PROCEDURES, "actor_terms": ACTORS, "action_terms": ACTIONS, "object_terms": OBJECTS, "qualifier_terms": QUALIFIERS}
    out = out.withColumns({name: found(clean, t) for name, t in tables.items()})
    out = concepts(out)
    topic = F.when(F.lit(False), "")
    for name, pattern in TOPICS.items():
        topic = topic.when(clean.rlike(pattern), name)
    out = out.withColumn("topic_class", topic.otherwise("general_legal"))
    sub = F.when(F.col("topic_class") == "administrative_sanction", "sanction").when(F.size("procedural_phrases") > 0, "procedural").when((F.size("actor_terms") > 0) & (F.size("action_terms") > 0), "subject_action").when(F.size("concept_tags") > 0, "concept_generic").otherwise("open")
    anchors = F.concat(*(F.when(clean.rlike(p), _array(a)).otherwise(_array([])) for p, a in ANCHOR_RULES))
    out = out.withColumn("subclass", sub).withColumn("legal_anchor_guess", F.slice(F.array_distinct(anchors), 1, 5))
    confidence = (
        F.lit(0.08) + F.least(F.lit(0.48), 0.16 * F.size("concept_tags")) + F.least(F.lit(0.20), 0.06 * F.size("strong_phrases")) + F.when(F.size("actor_terms") > 0, 0.08).otherwise(0.0)
        + F.when(F.size("action_terms") > 0, 0.10).otherwise(0.0) + F.when(F.size("object_terms") > 0, 0.06).otherwise(0.0) - F.when(clean.rlike(r"\b(dieu|khoan|chuong)\s+\d+"), 0.10).otherwise(0.0)
    )
    out = out.withColumn("concept_confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 6))
    out = out.withColumn("_words", sanitised(F.filter(F.split("clean", " "), lambda t: t != ""))).withColumns({"lexical_tokens": F.col("_words.kept"), "lexical_flags": F.col("_words.flags")}).drop("_words")
    words = lambda c: F.filter(F.flatten(F.transform(c, lambda p: F.split(p, " "))), lambda t: t != "")
    texts = lambda k: _of("concept_tags", {tag: t[k] for tag, t in CONCEPT_TEXTS.items()})
    tokens = lambda parts: F.filter(words(F.array_distinct(parts)), lambda t: (F.length(t) > 1) | t.rlike(r"^\d$"))
    head = lambda c, n: F.slice(F.col(c), 1, n)
    parts = F.concat(texts(0), head("strong_phrases", 2), head("actor_terms", 2), head("action_terms", 2), head("object_terms", 2))
    plain = F.slice(F.filter(F.split("clean", " "), lambda t: (F.length(t) > 1) | t.rlike(r"^\d$")), 1, 10)
    out = out.withColumn("lexical_query", F.array_join(F.slice("lexical_tokens", 1, 14), " ")).withColumn("_core", F.slice(F.when(F.size(parts) > 0, tokens(parts)).otherwise(plain), 1, 14))
    more = F.concat(F.array(F.array_join("_core", " ")), texts(1), head("actor_terms", 3), head("action_terms", 3), head("object_terms", 3), head("legal_anchor_guess", 3), head("lexical_tokens", 8))
    title = F.filter(F.array_distinct(F.concat(texts(2), head("legal_anchor_guess", 3), head("actor_terms", 2), head("object_terms", 2))), lambda p: ~p.isin("la gi", "quy dinh chung", "ve"))
    out = out.withColumns({
        "lexical_core": F.array_join("_core", " "), "lexical_expanded": F.array_join(F.slice(tokens(more), 1, 20), " "), "title_anchor": F.array_join(F.slice(tokens(title), 1, 12), " "),
        "concept_seed": F.array_join(F.slice(F.array_distinct(F.concat(words(F.slice("_expansions", 1, 6)), words(F.col("concept_phrases")), words(F.col("actor_terms")))), 1, 18), " "),
        "semantic_text": F.concat_ws(" ", F.col("ascii"), F.array_join("legal_anchor_guess", " ")),
    })
    content = F.size(F.filter("lexical_tokens", lambda t: ~t.rlike(r"^\d+$")))
    weak = (content < 3) & (F.size("strong_phrases") == 0)
    odd = F.col("ascii").rlike(AMBIGUOUS)
    no_concept, no_anchor = F.size("concept_tags") == 0, F.size("legal_anchor_guess") == 0
    hard = ((content < 2) & no_concept & (F.size("actor_terms") == 0) & (F.size("action_terms") == 0) & no_anchor) | (odd & no_concept & no_anchor)
    medium = (~no_concept & ((F.size("actor_terms") == 0) | (F.size("action_terms") == 0)) & (F.size("object_terms") == 0)) | (weak & (no_anchor | (content <= 3)))
    level = F.when(hard, "hard").when(medium, "medium").otherwise("none")
    flags = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in {
        "too_short": content < 2, "missing_actor": F.size("actor_terms") == 0, "missing_action": F.size("action_terms") == 0, "missing_object": F.size("object_terms") == 0, "weak_structure": weak, "ambiguous_noise": odd,
    }.items())))
    out = out.withColumns({"lexical_is_weak": weak, "vagueness_level": level, "vagueness_flags": flags})
    base = 0.54 + F.least(F.lit(0.20), 0.05 * F.size("strong_phrases")) + F.least(F.lit(0.15), 0.05 * F.size("legal_anchor_guess")) - F.when(F.col("lexical_is_weak"), 0.12).otherwise(0.0)
    c = F.greatest(F.least(F.lit(0.97), F.greatest(F.lit(0.05), base)), F.least(F.lit(0.97), 0.25 + 0.72 * F.col("concept_confidence")))
    c = F.when(F.col("vagueness_level") == "medium", F.greatest(F.lit(0.12), c - 0.08)).when(F.col("vagueness_level") == "hard", F.greatest(F.lit(0.08), c - 0.22)).otherwise(c)
    risk = F.size("vagueness_flags") * 2 + F.when(F.col("vagueness_level") == "hard", 4).otherwise(0)
    priors = F.create_map(*[x for k, v in TYPE_PRIORS.items() for x in (F.lit(k), _array(v))])
    local = F.col("ascii").rlike(LOCAL)
    return out.drop("_core", "_expansions").withColumns({
        "confidence": F.round(c, 6), "query_too_vague": F.col("vagueness_level") == "hard", "risk": F.when(risk >= 8, "high").when(risk >= 4, "medium").otherwise("low"),
        "doc_type_prior": F.element_at(priors, F.col("topic_class")), "doc_type_exclude": F.when(local, _array([])).otherwise(_array(["quyet_dinh_ubnd", "van_ban_dia_phuong"])),
        "bm25_query": F.coalesce(F.nullif(F.col("lexical_core"), F.lit("")), F.nullif(F.col("concept_seed"), F.lit("")), F.nullif(F.col("title_anchor"), F.lit("")), F.nullif(F.col("clean"), F.lit("")), F.col("ascii")),
    })


def recall_passes(plans: DataFrame) -> DataFrame:
    """(qid, pass, query): the BM25 passes of each concept query, for one batched search; vague ones get a recovery pass over their concepts' words."""
    passes = F.array(*(F.struct(F.lit(n).alias("pass"), F.col(c).alias("query")) for n, c in (("core", "lexical_core"), ("expanded", "lexical_expanded"), ("title", "title_anchor"))), F.struct(F.lit("recovery").alias("pass"), F.when(F.col("vagueness_level") != "none", F.col("concept_seed")).otherwise("").alias("query")))
    return plans.select("qid", F.explode(F.filter(passes, lambda p: p["query"] != "")).alias("p")).select("qid", "p.*")
