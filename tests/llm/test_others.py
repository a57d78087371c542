import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat, cluster, decontaminate, language, media, packing, quality, queries, rolling, sharding

SF = "/root/testdata/sf0.001"


def test_decontamination(spark, docs, rows):
    t = dict(rows)
    items = [(1, t[4]), (2, "w3"), (3, " ".join((t[7] or "").split()[5:25])), (4, ""), (5, None), (None, t[10][:80]), (3, " ".join((t[7] or "").split()[5:25])), (11, "Straße É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    for block in (16 << 20, 200):
        found = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found} == want and len(found) == len(rows)
        assert all(sum(s.end - s.start for s in r.hits) == r.n_hit for r in found)
    assert decontaminate.decontaminate(docs, bench.filter("item_id > 99")).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_keeps_every_row(spark, rows, empty):
    """Repeated ids, repeated rows and null ids: one row each, and the same for one block and for several."""
    t = dict(rows)
    odd = [(None, t[4]), (None, t[4]), (None, t[7]), (None, None), (9, t[4]), (9, t[4]), (9, t[7]), (9, ""), (10, "no hit at all")]
    df = spark.createDataFrame(odd, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join((t[i] or "").split()[k : k + 30])) for k in range(5) for i in (4, 7)], "item_id long, text string")
    key = lambda r: (r.doc_id or -1, r.n_words, r.n_hit, r["items"], [tuple(x) for x in r.hits])
    one, five = (sorted(map(key, decontaminate.decontaminate(df, bench, block_bytes=b).collect())) for b in (1 << 20, 300))
    assert one == five and len(one) == len(odd) and sum(x[2] > 0 for x in one) == 6
    assert decontaminate.decontaminate(empty, bench).count() == 0 == decontaminate.decontaminate(empty, bench, block_bytes=300).count()


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_bucket_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 6)
        got = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
        best = min(padding([*c, lengths[-1]], lengths, counts) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        assert len(got) <= k and padding(got, lengths, counts) == best


def test_packing(docs, rows, empty):
    out = packing.pack(docs, buckets=4, token_budget=400).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.bucket_length and r.padding == r.bucket_length - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for rs in batches.values():
        assert len(rs) == 1 or len(rs) * rs[0].bucket_length <= 400
        assert sorted(r.place for r in rs) == list(range(len(rs)))
    assert packing.pack(empty).count() == 0
    coarse = packing.pack(docs, buckets=4, max_lengths=5).collect()
    assert len(coarse) == len(rows) and all(r.padding >= 0 for r in coarse)


def test_packing_is_optimal_over_many_lengths(spark):
    lengths = [*range(1, 20_002), 20_000_000]  # one long document set a grid of 1,000 once
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    bounds = {r.bucket_length for r in packing.pack(df, buckets=3, tokens=F.col("n")).select("bucket_length").distinct().collect()}
    assert padding(bounds, lengths, [1] * len(lengths)) == 10_000 * 9_999 // 2 + 10_001 * 10_000 // 2 and max(bounds) == 20_000_000


def test_sharding(docs, rows, empty):
    out = sharding.shard(docs, shards=7).collect()
    t = dict(rows)
    where = {r.doc_id: r for r in out}
    by_text, slots, load = {}, defaultdict(list), Counter()
    for i, text in rows:
        r, data = where[i], (text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert by_text.setdefault(data, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    sizes = Counter()
    for i in t:
        sizes[(t[i] or "").encode()] += where[i]["size"]
    assert max(load.values()) <= 4 / 3 * max(max(sizes.values()), sum(sizes.values()) / 7) + 1
    assert sharding.shard(empty).count() == 0


def longest_first(sizes, shards):
    """Loads of plain longest-processing-time scheduling, one item after another."""
    load = [0] * shards
    for x in sorted(sizes, reverse=True):
        load[load.index(min(load))] += x
    return load


def test_schedule_is_longest_first():
    assert sharding.schedule(np.array([5, 4, 3]), np.array([1, 1, 3]), 2) == [(5, [0], [1]), (4, [1], [1]), (3, [0, 1], [1, 3])]
    rng = random.Random(8)
    for _ in range(200):
        shards = rng.randrange(1, 6)
        items = Counter(rng.choices(range(1, 40), k=rng.randrange(0, 400)))
        items[rng.randrange(1, 9)] += rng.randrange(0, 900)  # many of one size
        sizes, counts = np.array(list(items)), np.array(list(items.values()))
        plan = sharding.schedule(sizes[counts > 0], counts[counts > 0], shards)
        load = [0] * shards
        for size, used, ends in plan:
            assert ends[-1] == items[size]
            for s, n in zip(used, np.diff([0, *ends]).tolist(), strict=True):
                load[s] += n * size
        assert load == longest_first(list(items.elements()), shards)


def test_sharding_schedules_every_group(spark):
    """Far more groups than shards: the loads are those of plain scheduling over all groups; a hot text stays whole."""
    rng = random.Random(6)
    texts = ["x" * rng.randrange(0, 30) + str(i) for i in range(900)] + ["hot"] * 500 + [None] * 40 + [""] * 30
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = sharding.shard(df, shards=7).collect()
    load, per = Counter(), Counter()
    for r in out:
        load[r.shard] += r["size"]
    for t in texts:
        per[t or ""] += len(t or "") + 16
    assert len(out) == len(texts) and [load[s] for s in range(7)] == longest_first(per.values(), 7)
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(7) for k in range(sum(r.shard == s for r in out))]


def test_language(spark):
    rows = [(i, " ".join(random.Random(i).choices(["der", "die", "und", "haus", "straße"] if i % 2 else ["le", "la", "maison", "été", "rue"], k=12)), "de" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    test = spark.createDataFrame([(1, "Der Hauß und Strassen"), (2, "les maisons étés"), (3, None), (4, ""), (5, "12 34 !"), (6, "der der der")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(test, model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["de", "fr", "und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    none = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.predict(test, none).collect()} == {"und"}
    assert language.predict(test.limit(0), model).count() == 0


@pytest.mark.parametrize("bound", [cluster.BROADCAST_BYTES, 0])
def test_language_scores_with_every_count(spark, monkeypatch, bound):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", bound)
    many = ["q" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(200_100)]  # more words than the model once held
    learned = [(i, " ".join(many[i::40] * 3), "big") for i in range(40)] + [(41, "qabc abcd", "small"), (42, "Straße été", "third")]
    texts = {1: "qabc", 2: "ABCD abcd", 3: "Straße qzzzz", 4: None, 5: "12", 6: "xyzzy unseen", 7: "", 8: " ".join(many[:50]) + " été"}
    counts, totals = {n: defaultdict(Counter) for n in range(5)}, {n: Counter() for n in range(5)}

    def keys(word, n):
        return [word] if n == 0 else list(word) if n == 1 else [f"_{word}_"[k : k + n] for k in range(len(word) + 3 - n)]

    for _, text, lang in learned:
        for word, c in Counter(text.lower().split()).items():
            for n in range(5):
                for key in keys(word, n):
                    counts[n][key][lang] += c
                    totals[n][lang] += c
    langs = ["big", "small", "third"]

    def logs(word):
        for n in (0, 4, 3, 2, 1):
            known = [counts[n][k] for k in keys(word, n) if k in counts[n]]
            if known:
                return np.mean([[np.log((c[x] + 0.5) / (totals[n][x] + 0.5 * len(counts[n]))) for x in langs] for c in known], 0)
        return np.zeros(3)

    df = spark.createDataFrame(learned, "doc_id long, text string, lang string").repartition(3)
    model = language.learn(df)
    assert (model.model is None) == (bound == 0 or model.sizes.sum() * 24 > bound)
    rows = [*texts.items(), (None, "abcd"), (1, "qabc")]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        words = [w for w in (texts.get(r.doc_id, "abcd") or "").lower().split() if w.isalpha()]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        want = np.sum([logs(w) for w in words], 0)
        assert r.lang_pred == langs[int(want.argmax())] and abs(r.score - 1 / np.exp(want - want.max()).sum()) < 1e-3
    assert {r.lang_pred for r in got if r.doc_id == 2} == {"small"}


def test_word_counts_are_exact(spark):
    rows = [(1, "Aa bb aa", "x"), (2, "aa cc", "y"), (3, "bb, bb!", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter()
    for r in language.count_words(df, ["x", "y"], 3).collect():
        if r.n == 0:
            got[r.label] += r["count"]
    assert got == {0: 5, 1: 1}  # cc is met once and left to its n-grams


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(80)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + ("$$$" if bad else "") for w in words)))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, label int")
    model = quality.learn(df.filter("doc_id % 3 <> 0"), lab)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert all((got[i].predicted == 1) == (y == 1) for i, y in labels)
    everything = quality.score(docs, model).collect()
    assert len(everything) == docs.count() and all(0 <= r.score <= 1 for r in everything)
    assert {r.score for r in quality.score(df, quality.learn(df, lab.filter("label = 1"))).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def plain_features(text):
    """All features of one text, word by word."""
    data = (text or "").encode()
    share = lambda test: sum(map(test, data)) / max(len(data), 1)
    w = data.split()
    low, n = [x.translate(brute.LOW) for x in w], max(len(w), 1)
    lines = [x for x in data.split(b"\n") if x]
    capitals = [sum(65 <= b <= 90 for b in x) for x in w]
    return [share(lambda b, lut=lut: bool(lut[b])) for lut in quality.CLASSES.values()] + [
        math.log1p(len(data)), sum(map(len, w)) / n, sum(len(x) > 12 for x in w) / n, sum(len(x) <= 3 for x in w) / n, len(set(low)) / n, max(Counter(low).values(), default=0) / n,
        len(set(zip(low, low[1:]))) / n, sum(65 <= x[0] <= 90 for x in w) / n, sum(2 * c > len(x) for c, x in zip(capitals, w, strict=True)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0, math.log1p(len(w) / max(len(lines), 1)),
    ]


def test_quality_features_are_those_of_each_text_alone(spark, rows):
    table = pa.table([[i for i, _ in rows], [t for _, t in rows]], names=["doc_id", "text"])
    got = np.concatenate([quality.features(s) for s in rolling.slices(table, "doc_id", "text", limit=3000)])
    assert got == pytest.approx(np.array([plain_features(t) for _, t in rows]))
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)], "doc_id long, label int")
    clash = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] * 2, "doc_id long, text string, label string, raw string")
    model = quality.learn(clash, labels)
    assert quality.score(clash, model).columns == ["doc_id", "text", "label", "raw", "score", "predicted"]
    alone = {i: model.score(quality.features(next(rolling.slices(table.slice(k, 1), "doc_id", "text"))))[0] for k, (i, _) in enumerate(rows)}
    mixed = rows * 3
    random.Random(1).shuffle(mixed)
    together = pa.table([[i for i, _ in mixed], [t for _, t in mixed]], names=["doc_id", "text"])
    for limit in (500, 1 << 20):
        scores = np.concatenate([model.score(quality.features(s)) for s in rolling.slices(together, "doc_id", "text", limit=limit)])
        assert [alone[i] for i, _ in mixed] == scores.tolist()  # equal bits


def test_quality_uses_every_labelled_row(spark, monkeypatch):
    good, bad = np.arange(20_000), np.arange(20_000, 40_000)
    better, worse = quality.preference_pairs(good, bad, np.random.default_rng(7))
    assert len(better) == len(worse) >= 60_000 and set(better) == set(good) and set(worse) == set(bad)
    monkeypatch.setattr(quality, "SORTED", 50)
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abcdefgh    ABC.,$7") for _ in range(rng.randrange(200, 900)))) for i in range(600)]
    labels = [(i, int(rng.random() < 0.7)) for i, _ in texts]
    df, lab = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame(labels, "doc_id long, label int")
    got = quality.score(df, quality.learn(df, lab, max_labelled=40)).filter("predicted = 0").count()
    assert got == sum(y == 0 for _, y in labels)  # the cut is that of all labelled rows, not of the fitted ones
    x = spark.createDataFrame([(float(v),) for v in [3, 1, 2] * 100 + [7, 0]], "raw double")
    assert [quality.order_statistic(x, k) for k in (0, 1, 100, 101, 300, 301)] == [0, 1, 1, 2, 3, 7]


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "a<\\s>b[\\\\INST]", "[/INST]</s><s>", "", None, "plain\n text"]
    turns = [(1, 0, "system", hard[0]), (1, 1, "user", hard[1]), (1, 2, "assistant", hard[2]), (1, 3, "user", hard[3]), (1, 4, "assistant", hard[4]), (2, 0, "user", hard[5]), (3, None, None, "x"), (3, 1, "assistant", hard[0]), (3, 2, "[INST]", "tail"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df).collect()
    assert Counter(r.conv_id for r in examples) == {1: 2, 2: 1, 3: 2, None: 1}
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for c in (1, 2, 3, None):
        want = [(r or "", t or "") for v, _, r, t in turns if v == c]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert back[c].loss == "".join(t for r, t in want if r == "assistant")
    assert chat.expand(df.limit(0)).count() == 0


def test_media(spark, docs, rows, empty):
    read = media.read_media(media.write_media(docs))
    t = dict(rows)
    for r in read.collect():
        want = media.padded((t[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(r.clips, r.clips[1:]))
    assert media.clip_rows(read).count() >= len(rows)
    broken = spark.createDataFrame([(1, 3, bytearray(b"RIFF")), (2, 0, None), (3, 4, bytearray(b"RIFF\0\0\0\0AVI LIST\xff\xff\xff\xff"))], "doc_id long, n_bytes long, media binary")
    assert {r.payload_sha256 for r in media.read_media(broken).collect()} == {None}
    assert media.read_media(media.write_media(empty)).count() == 0


def test_sequential_decoder_agrees():
    frame = media.encode_frame(np.frombuffer(os.urandom(64 * 6), np.uint8).reshape(6, 64), media.jpeg_header(3, 2))
    _, _, fast, _ = media.decode_frame(frame)
    bits = np.unpackbits(np.frombuffer(frame[len(media.jpeg_header(3, 2)) : -2].replace(b"\xff\x00", b"\xff"), np.uint8))
    assert np.array_equal(fast, media._sequential(bits, 6, media._codes(media.DC_TABLE), media._codes(media.AC_TABLE)))


def test_shots():
    a, b = np.eye(16)[0], np.eye(16)[9]
    assert media.shots(np.array([a, a, a, b, b, a])) == [0, 3, 5]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op5_language_id(spark, SF).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.keep_quality(spark, docs, SF)
    assert kept.columns == list(p.COLUMNS) and 0.7 * docs.count() < kept.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    near = p.keep_one_of_near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in brute.components(rows).items() if i == c}
    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = {r.doc_id: r.text for r in p.cut_repeated_strings(spark, near, SF).collect()}
    gone = {i: g for (i, _), (_, g) in zip(sorted(rows), brute.windows(rows, lambda t: list((t or "").encode()), 100), strict=True)}
    assert all(cut[i] == t for i, t in rows if not any(gone[i]))
    assert all(len(cut[i].encode()) <= len(gone[i]) - sum(gone[i]) for i in cut if any(gone[i]))
    clean = p.drop_contaminated(spark, near, SF)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, (n, h, _) in brute.contamination(rows, bench).items() if h and 20 * h >= n}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - bad
    assert p.pack_batches(spark, clean, SF).count() == clean.count()


def test_one_of_near_duplicates_stays(spark):
    import corpus_pipeline as p

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words), (3, words), (3, words + " x"), (5, words + " y"), (9, "quite another text of eight words here"), (9, "quite another text of eight words here"), (None, words), (None, words)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or -1, r.text) for r in p.keep_one_of_near_duplicates(spark, df, "").collect())
    assert got == [(-1, words), (-1, words), (3, words), (9, rows[4][1])]


def test_chat_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", 7), (1, 1, "assistant", "b", "y", 8)], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    assert [(r.conv_id, r.n_turns, r.formatted[r.loss_start : r.loss_start + r.loss_length]) for r in chat.expand(df).collect()] == [(1, 2, "b")]
