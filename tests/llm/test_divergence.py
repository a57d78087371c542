"""The divergence audit against counting with dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import divergence

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ts = [t.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).decode() for t in TERM.findall((text or "").encode())]
        docs.update((lang, t) for t in set(ts))
        counts[lang, source].update(ts)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        shares = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            more = sorted((whole[t] - shares[s][t], t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(more[:top])]
    return sorted(out)


def rows_of(n_sources, n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "İX", "straße", "Ab", "AB"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = [(" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40))) + rng.choice(["", ".", "9x8", "\n"]), rng.choice(["en", "en", "fr", None]), rng.choice([f"s{rng.randrange(n_sources)}", "hot"])) for _ in range(n)]
    return [*out, (None, "en", "silent"), ("", "xx", None), ("lone words only here", "xx", "b"), ("1 2 3", "zz", "c"), *[("Copy copy COPY é", "de", f"d{k % 2}") for k in range(12)], ("word " * 30_000, "en", None)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "x") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, n string").repartition(4)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    return sorted(tuple(x) for x in df.collect())


def test_whole_result(spark):
    rows = rows_of(12, 700)
    assert result(divergence.audit(table(spark, rows), min_docs=10, top=7)) == expected(rows, 10, 7)


def test_tiles_and_pieces(spark, monkeypatch):
    """More sources than a tile holds, and words counted in many parts."""
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "WORDS", 500)
    monkeypatch.setattr(divergence, "SLICE", 1000)
    rows = rows_of(15, 500, seed=2)
    assert result(divergence.audit(table(spark, rows), min_docs=5, top=50)) == expected(rows, 5, 50)


def test_a_full_sketch_only_costs_time(spark):
    rows = rows_of(3, 200, seed=3)
    assert result(divergence.audit(table(spark, rows), min_docs=4, top=50, cells=64)) == expected(rows, 4, 50)


def test_sketch_never_tells_less(spark):
    rows = rows_of(3, 400, seed=4)
    read = table(spark, rows).selectExpr("0L AS at", "coalesce(text, '') AS text", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source")
    sketch = divergence.sketch(read.select("at", "text", "lang"), 256)
    found = divergence.possible_counts(read, np.full_like(sketch, 255), 1).groupBy("lang", "term").agg({"docs": "sum"}).collect()
    kept = {(x["lang"], x["term"]) for x in divergence.possible_counts(read, sketch, 20).collect()}
    assert {(x["lang"], x["term"]) for x in found if x["sum(docs)"] >= 20} <= kept < {(x["lang"], x["term"]) for x in found}


def test_empty(spark):
    assert result(divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))) == []


def test_bounds(spark):
    with pytest.raises(ValueError):
        divergence.audit(spark.createDataFrame([], "text string, lang string, source string"), min_docs=300)
    assert divergence.sketch_cells(0) == 1 << 16 and divergence.sketch_cells(100_000) == 1 << 21 and divergence.sketch_cells(10**9) == 1 << 24
