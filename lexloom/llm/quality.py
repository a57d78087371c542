"""Quality classifier: Bradley-Terry pairwise ranking over text features.

Preference pairs (a document of label 1, one of label 0) are drawn from a
bounded sample of labelled rows, every row of which is in a pair; weights
minimise the logistic loss on the differences of their features, which are
never held.  The score's cut is a quantile of the scores of all labelled rows:
the share of label 0 among them; it is moved to 0.3, the contract's threshold,
on the logistic scale.

Features are shares and means over the whole text's bytes and words (letters,
capitals, digits, marks, symbols, repeated words and lines, word lengths), as
they are and in quantile bins.

Edge cases: null and empty texts have zero features and a score like any
other; equal texts have equal scores, whatever stands beside them; without both
labels every score is 0.5; a label row without a text row, or the reverse,
teaches nothing; an id that is labelled twice takes the greater label, and of
several texts of a labelled id the fit takes one, the cut all; every row is
scored, repeated ones too; an empty table gives no rows.  ``learn`` looks only
at doc_id, text and label; ``score`` keeps all columns but ``score`` and
``predicted``, which give way to the result.  A text is held whole: one of n
bytes takes about 70 n bytes of a worker (measured at 8 MB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster
from lexloom.llm import rolling as r

#: Labelled rows of each label that the fit takes at most (the ones least by a hash of their id).
MAX_LABELLED, PAIRS, ROUNDS, BINS, CUT = 20_000, 60_000, 400, 12, 0.3
#: Parts of one to which standardised features and weights are rounded.
STEPS = 1 << 16
#: Scores that the search for an order statistic sorts at the driver.
SORTED = 10_000


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a:b] = True
    return out


#: ASCII classes and single marks that are counted (fixed values).
CLASSES = {
    "upper": _class((0x41, 0x5B)), "lower": _class((0x61, 0x7B)), "digit": _class((0x30, 0x3A)), "wide": _class((0x80, 0x100)),
    "stop": _class((0x2E, 0x2F), (0x2C, 0x2D)), "bang": _class((0x21, 0x22), (0x3F, 0x40)), "bar": _class((0x7C, 0x7D)),
    "symbol": _class((0x23, 0x27), (0x2A, 0x2C), (0x3C, 0x3F), (0x40, 0x41), (0x5B, 0x61), (0x7B, 0x7C), (0x7D, 0x7F)),
    "line": _class((0x0A, 0x0B)), "space": _class((0x20, 0x21)), "quote": _class((0x22, 0x23), (0x27, 0x2A)), "slash": _class((0x2F, 0x30), (0x3A, 0x3C), (0x2D, 0x2E)),
}
EXTRA = ("log_bytes", "word_length", "long_words", "short_words", "distinct", "top_word", "bigram_distinct", "first_upper", "all_upper", "repeat_lines", "line_words")
WIDTH = len(CLASSES) + len(EXTRA)
_PREFIX = {k: v.astype(np.int64) for k, v in CLASSES.items()}


def features(s: r.Slice) -> np.ndarray:
    """One row of features for each document of a slice."""
    n = len(s.ids)
    size = np.diff(s.bounds)
    out = np.zeros((n, WIDTH))
    for j, lut in enumerate(CLASSES.values()):
        c = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(lut[s.data], out=c[1:])
        out[:, j] = (c[s.bounds[1:]] - c[s.bounds[:-1]]) / np.maximum(size, 1)
    starts, ends, bounds = r.words(s, r.NOT_SPACE)
    count = np.diff(bounds)
    length = ends - starts
    doc = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    e = len(CLASSES)
    out[:, e] = np.log1p(size)
    out[:, e + 1] = np.bincount(doc, length, n) / per
    out[:, e + 2] = np.bincount(doc, length > 12, n) / per
    out[:, e + 3] = np.bincount(doc, length <= 3, n) / per
    if len(starts):
        h = r.word_hashes(r.LOWER[s.data], starts, ends)
        inside = doc[:-1] == doc[1:]  # a pair never spans two documents
        pairs = r.mix(h[:-1] * np.uint64(3) ^ h[1:])[inside]
        for col, keys, d in ((e + 4, h, doc), (e + 6, pairs, doc[:-1][inside])):
            order = np.lexsort((keys, d))
            k, d = keys[order], d[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            at = np.flatnonzero(new)
            out[:, col] = np.bincount(d[at], minlength=n) / per
            if col == e + 4:
                np.maximum.at(out[:, e + 5], d[at], np.diff(np.append(at, len(k))))
        out[:, e + 5] /= per
        up = CLASSES["upper"][s.data]
        c = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(up, out=c[1:])
        caps = c[ends] - c[starts]
        out[:, e + 7] = np.bincount(doc, up[starts], n) / per
        out[:, e + 8] = np.bincount(doc, caps * 2 > length, n) / per
    line_bytes = np.ones(256, bool)
    line_bytes[10] = False
    a, b, lines = r.words(s, line_bytes)
    n_lines = np.diff(lines)
    if len(a):
        h, d = r.word_hashes(s.data, a, b), np.repeat(np.arange(n), n_lines)
        order = np.lexsort((h, d))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
        out[:, e + 9] = np.where(n_lines > 0, 1 - np.bincount(d[order][new], minlength=n) / np.maximum(n_lines, 1), 0)
    out[:, e + 10] = np.log1p(count / np.maximum(n_lines, 1))
    return out


class Ranker:
    """Linear scores on standardised and binned features, with the cut that stands at ``CUT``."""

    def __init__(self, edges: np.ndarray, mean: np.ndarray, std: np.ndarray, weights: np.ndarray, cut: float, scale: float):
        self.edges, self.mean, self.std, self.weights, self.cut, self.scale = edges, mean, std, weights, cut, scale

    def design(self, x: np.ndarray) -> np.ndarray:
        n, m, k = len(x), x.shape[1], self.edges.shape[1]
        out = np.empty((n, m * (k + 1)), np.float32)
        out[:, :m] = np.rint(np.clip((x - self.mean) / self.std, -5, 5) * STEPS) / STEPS
        for j in range(m):
            out[:, m + j * k : m + (j + 1) * k] = x[:, j : j + 1] > self.edges[j]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Exact sums (short binary fractions on both sides), so that a score never depends on the rows beside it."""
        return self.design(x).astype(float) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.raw(x) - self.cut) * self.scale + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def preference_pairs(good: np.ndarray, bad: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """At least ``PAIRS`` pairs in which every row takes part, each about equally often."""
    n = max(PAIRS, len(good), len(bad))
    return tuple(np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n] for side in (good, bad))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker | None:
    """Minimise the logistic loss of preference pairs by full-batch gradient steps with momentum; the cut is still open."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(x, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    # Rare kinds of junk fill few quantile bins, so the bins of label 0 stand beside those of all.
    edges = np.sort(np.concatenate([edges, np.quantile(x[bad], np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T], 1), 1)
    model = Ranker(edges, x.mean(0), x.std(0) + 1e-9, np.zeros(0), 0.0, 1.0)
    d = model.design(x)
    rng = np.random.default_rng(seed)
    better, worse = preference_pairs(good, bad, rng)
    w, m, v = (np.zeros(d.shape[1], np.float32) for _ in range(3))
    for t in range(1, ROUNDS + 1):
        s = d @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        of_row = np.bincount(better, pull, len(d)) - np.bincount(worse, pull, len(d))
        g = -(of_row.astype(np.float32) @ d) / len(better) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights = np.rint(w.astype(float) * STEPS) / STEPS
    model.scale = float(1 / ((d @ w).astype(float).std() + 1e-9))
    return model


def feature_rows(docs: DataFrame) -> DataFrame:
    """(label, features) of the (doc_id, text, label) rows, one of each id."""

    def go(batches):
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                x = features(s)
                part = batch.slice(s.rows.start, len(x))
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), WIDTH).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    found = docs.mapInArrow(go, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, features array<double>")
    return found.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("row")).select("row.*")


def raw_scores(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, raw) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                yield pa.record_batch([batch.column("doc_id").slice(s.rows.start, len(s.ids)), pa.array(held.value.raw(features(s)).astype(float))], names=["doc_id", "raw"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(go, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw double")


def order_statistic(scores: DataFrame, at: int) -> float:
    """The ``raw`` that stands at place ``at`` (from 0) in ascending order, found by counts in ever narrower bins."""
    lo, hi, n = scores.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    while n > SORTED and lo < hi:
        place = F.least(F.floor((F.col("raw") - F.lit(lo)) / F.lit(hi - lo) * 1024), F.lit(1023))
        inside = scores.filter(F.col("raw").between(lo, hi)).groupBy(place.alias("bin")).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("raw").alias("n"))
        for x in sorted(inside.collect(), key=lambda x: x.bin):
            lo, hi, n = x.lo, x.hi, x.n
            if at < n:
                break
            at -= n
    return lo if lo == hi else sorted(x.raw for x in scores.filter(F.col("raw").between(lo, hi)).select("raw").collect())[at]


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker | None:
    """Learn from (doc_id, text) and (doc_id, label 0/1): weights from at most ``max_labelled`` rows of each label, the cut from all."""
    docs = docs.select("doc_id", "text")
    labels = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {x.label: x["count"] for x in labels.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    chosen = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for k in (0, 1)]
    got = feature_rows(docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")).toArrow()
    if not got.num_rows:
        return None
    x = np.asarray(got.column("features").combine_chunks().flatten()).reshape(-1, WIDTH)
    y = got.column("label").to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the rows' order of arrival must not matter
    model = fit(x[order], y[order])
    if model is not None:
        scores = cluster.cut(raw_scores(docs, model).join(labels.filter("label IN (0, 1)"), "doc_id").select("label", "raw"), "op7-scores")
        of = {x.label: x["count"] for x in scores.groupBy("label").count().collect()}
        at = min(of.get(0, 0) + of.get(1, 0) - 2, of.get(0, 0) - 1)
        model.cut = (order_statistic(scores, at) + order_statistic(scores, at + 1)) / 2  # between the two scores at the quantile
        cluster.drop(scores)
    return model


def score(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``, by (doc_id, text) alone."""
    docs = docs.drop("score", "predicted")  # a clashing column gives way to the result
    held = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        m = held.value
        for batch in batches:
            for s in r.slices(batch, "doc_id", "text"):
                got = m.score(features(s)) if m is not None else np.full(len(s.ids), 0.5)
                part = batch.slice(s.rows.start, len(got))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array(got >= CUT).cast(pa.int32())], names=[*part.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(go, f"{schema}, score double, predicted int")
