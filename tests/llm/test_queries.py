"""Every registered query of the training-data operators on the smallest tables: against SQL, brute force or the contract's own words."""

import hashlib
import html
import os
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_others import longest_first

from lexloom.llm import media, packing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TYPES = {
    "op1_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint", "op2_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", "op4_packing": "doc_id bigint", "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "op9_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op11_html_extraction": "page_id bigint, url string, text string, n_chars bigint", "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def get(name):
        if name not in kept:
            df = queries.QUERIES[name](spark, SF)
            types = dict(df.dtypes)
            assert {c: types[c] for c in (x.split()[0] for x in TYPES[name].split(", "))} == dict(x.split() for x in TYPES[name].split(", "))
            kept[name] = df.collect()
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, results):
    con = duckdb.connect()
    for n in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    rows = results(name)
    r = con.sql(queries.ORACLES[name])
    assert sorted(r.columns) == sorted(rows[0].asDict())
    assert Counter(tuple(x[c] for c in r.columns) for x in rows) == Counter(r.fetchall())


def test_every_operator_has_a_query():
    assert set(queries.QUERIES) == set(TYPES)


def test_op4_is_the_best_partition(results, texts):
    """Bounds of least padding by the plain quadratic programme over all distinct lengths; batches within the budget."""
    rows = results("op4_packing")
    words = {i: len(brute.re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == words
    hist = Counter(words.values())
    lengths = sorted(hist)
    n = len(lengths)
    best = [[float("inf")] * n for _ in range(17)]
    for j in range(n):
        for k in range(1, 17):
            cost = 0
            for a in range(j, -1, -1):  # the last bucket holds lengths a..j
                cost += hist[lengths[a]] * (lengths[j] - lengths[a])
                before = 0 if a == 0 else best[k - 1][a - 1] if k > 1 else float("inf")
                best[k][j] = min(best[k][j], before + cost)
    assert sum(r.padding for r in rows) == min(best[k][n - 1] for k in range(1, 17))
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r)
    assert all(len(b) == 1 or len(b) * b[0].bucket_length <= 65_536 for b in batches.values())
    per = Counter(k for k, _ in batches)
    for (k, number), b in batches.items():  # no batch but a bucket's last could take one more
        assert number == per[k] - 1 or (len(b) + 1) * b[0].bucket_length > 65_536


def test_op5_learns_from_the_fold_alone(results, texts, spark):
    rows = results("op5_language_id")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text = defaultdict(set)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
        by_text[texts[r.doc_id]].add((r.lang_pred, r.score))
    assert all(len({x for x, _ in v}) == 1 and np.ptp([s for _, s in v]) < 1e-5 for v in by_text.values())


def test_op6_is_longest_first_over_all_groups(results, texts):
    rows = results("op6_sharding")
    load, size, slots, where = Counter(), Counter(), defaultdict(list), {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r.shard) == r.shard
        load[r.shard] += r["size"]
        size[data] += r["size"]
        slots[r.shard].append(r.slot)
    assert [load[s] for s in range(40)] == longest_first(size.values(), 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op7_equal_texts_have_equal_scores(results, texts):
    by_text = defaultdict(set)
    for r in results("op7_quality_classifier"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        by_text[texts[r.doc_id]].add(r.score)
    assert all(len(v) == 1 for v in by_text.values()) and sum(map(len, by_text.values())) == len(by_text)


def test_op8_against_brute_force(results, texts):
    got = {r.doc_id: r for r in results("op8_suffix_array_dedup")}
    seen = set()
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert tuple(got[i]) == (i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op11_reads_the_article(results):
    """The pages of these tables have one article of headings and paragraphs, which the page's own tags tell."""
    pages = pq.read_table(f"{SF}/pages.parquet")
    raw = dict(zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist(), strict=True))
    rows = results("op11_html_extraction")
    assert sorted(r.page_id for r in rows) == sorted(raw)
    for r in rows:
        inner = brute.re.search(r"<article>(.*)</article>", raw[r.page_id], brute.re.S)[1]
        blocks = (" ".join(html.unescape(brute.re.sub(r"<br>|</?b>", " ", b)).split()) for b in brute.re.split(r"</?(?:h1|p)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op10_reads_its_media_back(results, texts):
    """Payload by its definition; media, histogram and shots by decoding every block on its own, pixel by pixel."""
    k = np.arange(8)
    dct = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    rows = results("op10_media_columns")
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        want = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        blob = media.write_avi(want)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    for r in sorted(rows, key=lambda x: x.n_bytes)[:: max(1, len(rows) // 12)]:
        data = (texts[r.doc_id] or "").encode()
        _, _, frames = media.read_avi(media.write_avi(media.padded(data)))
        hist = np.zeros(16, int)
        for f in frames:
            _, _, coefficients, quant = media.decode_frame(f)
            for block in coefficients * quant:
                square = np.zeros(64)
                square[media.ZIGZAG] = block
                pixels = np.clip(np.rint(dct @ square.reshape(8, 8) @ dct.T) + 128, 0, 255).astype(int)
                hist += np.bincount(pixels.reshape(-1) >> 4, minlength=16)
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert int(told["frames"]) == len(frames)
        assert np.abs(np.array(told["hist"].split(","), int) - hist).sum() <= hist.sum() / 500  # roundings at the edge of a bin


def test_very_long_text(spark):
    """One text of 1.5 MB beside short ones goes through every operator whole."""
    from lexloom.llm import decontaminate, jaccard, language, quality, sharding, substring, suffix

    long = " ".join(f"word{i % 70_000} of{i % 977}" for i in range(100_000))
    rows = [(1, long, "en", 1), (2, long + " tail", "en", 1), (3, "a short text of eight words is here", "fr", 0), (4, "", "fr", 0), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(2)
    bench = spark.createDataFrame([(7, " ".join(long.split()[500:520]))], "item_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(df, bench).collect()} == {1: 20, 2: 20, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.n_words - r.n_removed for r in substring.substring_dedup(df).filter("doc_id > 1").collect()} == {2: 1, 3: 8, 4: 0, 5: 0}
    assert {r.doc_id: r.n_bytes - r.n_removed for r in suffix.suffix_dedup(df).filter("doc_id > 1").collect()}[2] == 5
    assert packing.pack(df, buckets=2).count() == sharding.shard(df, shards=2).count() == 5
    assert {r.doc_id: r.lang_pred for r in language.predict(df, language.learn(df)).collect()} == {1: "en", 2: "en", 3: "fr", 4: "und", 5: "und"}
    assert quality.score(df, quality.learn(df, df)).count() == 5
    assert {r.payload_bytes for r in media.read_media(media.write_media(df.filter("doc_id = 1"))).collect()} == {-(-len(long) // 64) * 64}
