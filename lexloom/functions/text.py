"""Text normalisation, tokenisation and scalar functions as column expressions.

Only Unicode normalisation, entity unescaping and byte repair have no built-in
and are Arrow-batched UDFs; everything else stays inside code generation.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WORD = "[0-9A-Za-zÀ-ỹĐđ]+"
#: Letters that lose their stroke but have no decomposition (fixed values).
STROKES = ("đĐ", "dD")
BASES = "aAeEiIoOuUyYcCnN"


def _mapped(f):
    def go(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return go


nfc = pandas_udf(_mapped(lambda x: unicodedata.normalize("NFC", x)), StringType())
unescape_html = pandas_udf(_mapped(html.unescape), StringType())


#: Blocks without a character that composing could change; text with any other goes through :func:`nfc`.
COMPOSED = r"[^\x00-\u02FF\u1EA0-\u1EF9\u2010-\u2027\u2030-\u205E\u20A0-\u20BF]"


def composed(x: Column) -> Column:
    """NFC; only text that may need it leaves the JVM. Latin text is told by one range, which costs far less than the whole class."""
    return F.coalesce(nfc(F.when(x.rlike(r"[^\x00-\u02FF]") & x.rlike(COMPOSED), x)), x)


def _fold_table() -> tuple[str, str]:
    """Precomposed letters up to U+1EF9 and their base letters, by the rule of canonical decomposition."""
    found = {}
    for code in range(0xC0, 0x1EFA):
        first = unicodedata.normalize("NFD", chr(code))
        if len(first) > 1 and first[0] in "aAbBcCdDeEfFgGhHiIjJkKlLmMnNoOpPqQrRsStTuUvVwWxXyYzZ":
            found[chr(code)] = first[0]
    return "".join(found) + STROKES[0], "".join(found.values()) + STROKES[1]


FOLD_FROM, FOLD_TO = _fold_table()


def trim_unicode(x: Column) -> Column:
    """Strip every kind of white space, the no-break space too."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def safe_string(x: Column) -> Column:
    """Null becomes empty; else trimmed."""
    return F.coalesce(trim_unicode(x.cast("string")), F.lit(""))


def clean_value(x: Column) -> Column:
    """Blank becomes null; else trimmed."""
    t = trim_unicode(x.cast("string"))
    return F.when(t != "", t)


def blank_literals(x: Column) -> Column:
    """As :func:`safe_string`, and the literals None, nan and NaN become empty."""
    t = safe_string(x)
    return F.when(t.isin("None", "nan", "NaN"), "").otherwise(t)


def strip_tags(x: Column) -> Column:
    """Line breaks for ``<br>``, then tags removed without a space in their place."""
    return F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def collapse(x: Column) -> Column:
    """Runs of spaces and tabs to one space, three line feeds or more to two, ends stripped."""
    return trim_unicode(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_text(x: Column) -> Column:
    """NFC, entities, tags, control characters, white space; null and empty give empty."""
    return F.coalesce(collapse(strip_controls(strip_tags(unescape_html(nfc(x))))), F.lit(""))


def clean_text_native(x: Column) -> Column:
    """The same for text that is NFC and free of entities, without leaving the JVM."""
    return F.coalesce(collapse(strip_controls(strip_tags(x))), F.lit(""))


def word_count(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(r"(?U)[^\s]+")), F.lit(0))


def token_estimate(x: Column) -> Column:
    """Three halves of the words, cut to an integer."""
    return F.floor(word_count(x) * 1.5).cast("int")


def token_source(x: Column, normalise: bool = False) -> Column:
    """Text whose matches of :data:`WORD` are its tokens; an underscore parts them as a space does, so it may stay."""
    return F.lower(composed(x) if normalise else x)


def tokens(x: Column, query: bool = False, normalise: bool = False) -> Column:
    """Lower-cased index tokens; for queries without one-character tokens that are no digits. Indexes and searches ask for NFC."""
    found = F.regexp_extract_all(token_source(x, normalise), F.lit(WORD), F.lit(0))
    if query:
        found = F.filter(found, lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))
    return F.coalesce(found, F.array().cast("array<string>"))


def token_text(x: Column, query: bool = False) -> Column:
    return F.array_join(tokens(x, query), " ")


def fold(x: Column) -> Column:
    """Accents off, by one translate over precomposed letters; leftover marks removed."""
    return F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def ascii_normal(x: Column) -> Column:
    """Folded, lower, everything but letters and digits a space, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def ascii_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(fold(x)), F.lit("[a-z0-9]+"), F.lit(0))


def match_normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def folded_query(*parts: Column) -> Column:
    """Query tokens of the joined parts, folded: what every heuristic looks at."""
    return F.lower(fold(token_text(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)), query=True)))


def family_key(title: Column) -> Column:
    """A law's name without consolidation words and years, from the law word on."""
    v = folded_query(title)
    v = F.regexp_replace(v, r"\bvan\s+ban\s+hop\s+nhat\b", " ")
    v = F.regexp_replace(v, r"\b(sua\s+doi|bo\s+sung|hop\s+nhat)\b", " ")
    tail = F.regexp_extract(v, r"\b((?:bo\s+luat|luat)\b\s+.+)", 1)
    v = F.when(tail != "", tail).otherwise(v)
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"\b(19|20)\d{2}\b", " "), r"\s+", " "))


def document_key(number: Column, doc_id: Column) -> Column:
    n = F.nullif(F.upper(F.trim(F.coalesce(number, F.lit("")))), F.lit(""))
    return F.coalesce(F.concat(F.lit("doc::"), n), F.concat(F.lit("id::"), doc_id))


def family_match(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; never with an empty key."""
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))


def phrases(x: Column, min_length: int = 0) -> Column:
    """Distinct unigrams and adjacent bigrams, unigrams first."""
    t = tokens(x, query=True)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_union(t, pairs), lambda p: F.length(p) >= min_length)


def phrase_focus(x: Column, phrase: str) -> Column:
    """Whether the text holds all but at most one of the phrase's words (two at least)."""
    words = sorted(set(phrase.split()))
    return F.size(F.array_intersect(F.array(*map(F.lit, words)), ascii_tokens(x))) >= max(2, len(words) - 1)


def focus_terms(x: Column, stop: list[str], limit: int = 3) -> Column:
    """The first distinct folded tokens that are no stop words, digits or short."""
    keep = F.filter(ascii_tokens(x), lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+$") & (F.length(t) >= 3))
    return F.slice(F.array_distinct(keep), 1, limit)


def law_name_phrase(title: Column, words: int = 8) -> Column:
    """The law's name in a title: cut at year, amendment, guidance or subject words."""
    v = F.regexp_extract(ascii_normal(title), r"\b((?:bo luat|luat)\b.*)", 1)
    v = F.regexp_replace(v, r"\s(?:nam \d{4}|sua doi|huong dan|ve)\b.*$", "")
    return F.array_join(F.slice(F.split(v, " "), 1, words), " ")


#: Vietnamese words without accents, and legal words (fixed values).
KNOWN_UNACCENTED = ("la", "cua", "va", "cho", "khong", "duoc", "nhung", "trong", "theo", "quy", "dinh", "luat", "dieu", "khoan", "nghi", "thong", "tu", "nguoi", "lao", "dong", "the", "nao", "gi", "khi", "ve", "phai", "co", "bao", "nhieu")
LEGAL_UNACCENTED = ("luat", "nghi dinh", "thong tu", "dieu", "khoan", "quy dinh")


def query_language(x: Column) -> Column:
    """vi by the share of marked letters, vi_no_accent by known words or legal words, mixed without letters, else en."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    marked = F.length(F.regexp_replace(F.lower(x), "[^ăâđêôơưà-ãè-éì-íò-õù-úýẠ-ỹ]", ""))
    t = ascii_tokens(x)
    known = F.size(F.filter(t, lambda w: w.isin(*KNOWN_UNACCENTED)))
    legal = ascii_normal(x).rlike(r"\b(" + "|".join(LEGAL_UNACCENTED) + r")\b")
    return (
        F.when(letters == 0, "mixed").when(marked / letters > 0.05, "vi")
        .when((known / F.greatest(F.size(t), F.lit(1)) > 0.35) | legal, "vi_no_accent").otherwise("en")
    )


def _mend(x: str) -> str:
    def rank(t: str) -> int:
        good = sum(t.count(c) for c in "ăâđêôơưáàảãạấầẩẫậếềểễệốồổỗộớờởỡợứừửữự")
        return 3 * good - sum(t.count(c) for c in "ÃÂÄÅÆ»º¡")

    tried = [x]
    for enc in ("latin-1", "cp1252"):
        try:
            tried.append(x.encode(enc).decode("utf-8"))
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return max(tried, key=rank)


mend_mojibake = pandas_udf(_mapped(_mend), StringType())


def normal_url(x: Column) -> Column:
    """Without fragment, query and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"[#?].*$", ""), r"/+$", "")


def url_parts(x: Column) -> Column:
    """(org, page) of a listing URL: its ``org`` parameter and its page number, 1 without one."""
    org = F.regexp_extract(x, r"[?&]org=([^&#]*)", 1)
    return F.struct(org.alias("org"), F.coalesce(F.nullif(F.regexp_extract(x, r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("page"))


def text_digest(x: Column) -> Column:
    return F.substring(F.sha1(F.encode(x, "UTF-8")), 1, 16)


def completeness(answer: Column) -> Column:
    n = F.length(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(n == 0, 1).when(n < 120, 2).when(n < 300, 3).when(n < 700, 4).otherwise(5)


def answer_contains(answer: Column, *expected: Column) -> Column:
    hay = match_normal(answer)
    out = F.lit(False)
    for e in expected:
        out = out | ((match_normal(e) != "") & F.contains(hay, match_normal(e)))
    return out


def json_object(x: Column, schema: str) -> Column:
    """Parsed JSON, with an empty value of the schema where it does not parse."""
    return F.coalesce(F.from_json(x, schema), F.from_json(F.lit("{}" if not schema.startswith("array") else "[]"), schema))


def embedding_text(text: Column, title: Column, limit: int = 4000) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(text), F.lit("")), title), 1, limit)


def parse_list(x: Column) -> Column:
    """``"a, b"`` or ``"['a','b']"`` as an array of trimmed, non-empty strings."""
    quoted = F.from_json(F.regexp_replace(x, "'", '"'), "array<string>")
    plain = F.split(F.regexp_replace(x, r"^\[|\]$", ""), ",")
    found = F.when(F.trim(x).startswith("["), F.coalesce(quoted, plain)).otherwise(plain)
    return F.coalesce(F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: v != ""), F.array().cast("array<string>"))


def reading_decision(x: Column) -> Column:
    """Preprocessing record of a query: language, whether it is rejected, and its enriched text."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.struct(query_language(t).alias("language"), (t == "").alias("rejected"), F.when(query_language(t) == "vi_no_accent", ascii_normal(t)).otherwise(t).alias("enriched"))
