import random

import brute
import numpy as np
import pytest

from lexloom.llm import jaccard, rolling, substring, suffix


def check_substring(docs, rows, window):
    got = {r.doc_id: r for r in substring.substring_dedup(docs, window=window).collect()}
    units = lambda t: (t or "").encode().split()
    for (i, _), (u, gone) in zip(sorted(rows), brute.windows(rows, units, window), strict=True):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == (len(u), sum(gone), b" ".join(x for x, g in zip(u, gone, strict=True) if not g))
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_substring(docs, rows):
    check_substring(docs, rows, 20)


def test_substring_short_window(docs, rows):
    check_substring(docs, rows, 3)


@pytest.mark.parametrize("length", [100, 20, 5])
def test_suffix(docs, rows, length):
    got = {r.doc_id: r for r in suffix.suffix_dedup(docs, length=length).collect()}
    for (i, _), (u, gone) in zip(sorted(rows), brute.windows(rows, lambda t: list((t or "").encode()), length), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(u), sum(gone), bytes(x for x, g in zip(u, gone, strict=True) if not g))


def test_covers():
    for v, cover in suffix.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_jaccard(docs, rows):
    want = brute.components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_many_blocks_and_groups(spark, docs, rows, monkeypatch):
    """Tiny blocks, chunks and fans: the results are those of one task."""
    from lexloom.llm import repeats

    want = brute.components(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(repeats, "FAN", 4)
    monkeypatch.setattr(repeats, "CHUNK", 50)
    monkeypatch.setattr(repeats, "PER_PARTITION", 40)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == want
    check_substring(docs, rows, 20)
    got = {r.doc_id: r.n_removed for r in suffix.suffix_dedup(docs, length=100).collect()}
    assert got == {i: sum(g) for (i, _), (_, g) in zip(sorted(rows), brute.windows(rows, lambda t: list((t or "").encode()), 100), strict=True)}


def test_large_group_of_near_copies(spark):
    """One family of texts that share most signatures, in parts that do not link; exact copies and ids of several texts among them."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = base[:]
        for k in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 5))):
            words[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute.components(rows)


def test_signatures_lose_no_link():
    """Random pairs at the threshold always share a signature, whatever the sizes."""
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(80, 5000)
    for size in (4, 5, 6, 7, 9, 10, 14, 18, 25, 40, 80, 200, 600, 1500):
        for _ in range(40):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            most = size // 9  # changed elements keep (n - c) / (n + c) at 0.8 or more
            b = np.concatenate([a[most:], rng.integers(0, 2**63, most).astype(np.uint64)])
            if rng.random() < 0.5 and size >= 5:
                b = a[: -(size // 5)]
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both < 80 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            h, doc = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
            seen = [set(), set()]
            for sig, owner in jaccard.signatures(h, doc, np.array([len(a), len(b)]), bands):
                for d in (0, 1):
                    seen[d] |= set(sig[owner == d].tolist())
            assert seen[0] & seen[1], (size, len(b))


def test_empty_and_nulls(spark, empty):
    assert substring.substring_dedup(empty).count() == 0
    assert suffix.suffix_dedup(empty).count() == 0
    assert suffix.without_repeats(empty).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (2, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert got == [(2, 2, 2), (2, 2, 2), (5, 2, 2), (None, 0, None), (None, 2, None)]
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_removed)
    # The null id comes first; rows of one id are no repeats of themselves, but all are repeats of the null id's text.
    assert sorted(map(key, substring.substring_dedup(odd, window=3).collect())) == [(-1, 0), (-1, 0), (2, 6), (2, 6), (5, 6)]
    assert sorted(map(key, suffix.suffix_dedup(odd, length=5).collect())) == [(-1, 0), (-1, 0), (2, 11), (2, 11), (5, 11)]
    twice = odd.filter("doc_id = 2")
    assert {r.n_removed for r in substring.substring_dedup(twice, window=3).collect()} == {r.n_removed for r in suffix.suffix_dedup(twice, length=5).collect()} == {0}


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        h = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        ids, offs = rng.choice(np.array([-(2**63), -5, 0, 3, 2**40]) if n < 100 else np.arange(50), n), rng.integers(0, 70000, n)
        got = rolling.unpack(rolling.pack(h, ids, offs))
        assert all(np.array_equal(x, y) for x, y in zip(got, (h, ids, offs), strict=True))


def test_characters_stay_whole(spark):
    shared = "é" * 80 + "abc"
    df = spark.createDataFrame([(1, "x" + shared, "en", "s", 0), (2, "yz" + shared + "ü", "en", "s", 0), (3, shared * 2, None, None, None), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in suffix.without_repeats(df, length=31).collect()}
    assert out[1].text.startswith("x") and out[4].text is None
    assert all("�" not in (r.text or "") and (r.text is None or r.doc_id == 4 or r.n_chars == len(r.text) or r.n_chars == 0) for r in out.values())


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.suffix_dedup(df, length=9).collect()}
    want = {i: sum(g) for (i, _), (_, g) in zip(sorted(rows), brute.windows(rows, lambda t: list(t.encode()), 9), strict=True)}
    assert got == want
