import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, ties and marked letters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "straße", "naïve", "İx", "Ab", "cd"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [text(n) for n in (120, 60, 300, 45, 25, 20, 19, 7, 5, 4, 3, 1)]
    passage = text(70)
    out = [*base, *base[:4], None, "", "   \n\t", "a", base[0] + " tail", "head " + base[1], base[0].upper(), base[2].replace("w1 ", "w2 "), passage + " " + text(50), text(30) + "\n" + passage, passage, passage + "  " + passage, "é" * 300, "é" * 300 + "x", text(3000)]
    for _ in range(25):
        words = base[2].split()
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, bucket int, shard string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
