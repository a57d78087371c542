"""Stored indexes: commits, interrupted appends, replayed batches, and vector lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import index as IX
from lexloom.operators import retrieval as V
from lexloom.operators import vectors as VX
from lexloom.sources import shared
from lexloom.sources.versions import Conflict, Store
from lexloom.streaming import events


def table(spark, ids):
    return spark.createDataFrame([(i, f"chung word{i % 3} chỉ{i}" if i % 4 else "") for i in ids], "doc_id long, text string")


def state(ix):
    return (
        sorted(tuple(r) for r in ix.postings.select("bucket", "term", "field", "id", "tf", "len").collect()),
        sorted(tuple(r) for r in ix.terms.groupBy("bucket", "term", "field").agg(F.sum("df")).collect()),
        sorted(tuple(r) for r in ix.totals.groupBy("field").agg(F.sum("n"), F.sum("tokens")).collect()), sorted(r[0] for r in ix.documents.collect()),
    )


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return state(IX.build(table(spark, range(20)), str(tmp_path_factory.mktemp("whole"))))


@pytest.mark.parametrize("fails", ["postings", "terms", "documents", "totals", "commit"])
def test_an_interrupted_append_leaves_nothing(spark, tmp_path, monkeypatch, whole, fails):
    path = str(tmp_path)
    before = state(IX.build(table(spark, range(8)), path))
    stage, commit = Store.stage, Store.commit

    def broken(self, name, rows, by=None):
        out = stage(self, name, rows, by)
        if name == fails:
            raise OSError("lost after this write")
        return out

    def lost(self, *args, **more):
        if fails == "commit":
            raise OSError("lost before the manifest")
        return commit(self, *args, **more)

    monkeypatch.setattr(Store, "stage", broken)
    monkeypatch.setattr(Store, "commit", lost)
    with pytest.raises(OSError):
        IX.append(table(spark, range(20)), path, batch=("a", 1))
    monkeypatch.undo()
    assert state(IX.read(spark, path)) == before
    for _ in range(2):
        assert state(IX.append(table(spark, range(20)), path, batch=("a", 1))) == whole
    store = Store(spark, path)
    assert store.vacuum() and state(IX.read(spark, path)) == whole and not store.vacuum()
    assert store.versions() == [1, 2] and state(IX.read(spark, path, version=1)) == before
    assert store.manifest()["created_at"] == store.manifest(1)["created_at"] and store.manifest()["batches"] == {"a": 1}


def test_batches_and_repeated_ids(spark, tmp_path, whole):
    path = str(tmp_path)
    IX.build(table(spark, [*range(5), 0, 1]), path, batch=("s", 0))
    IX.append(table(spark, range(3, 12)), path, batch=("s", 1))
    assert IX.append(table(spark, range(90, 99)), path, batch=("s", 1)).documents.count() == 12  # the batch is in it already
    assert state(IX.append(table(spark, [*range(20), 19]), path)) == whole
    assert state(IX.append(table(spark, []), path, batch=("s", 2))) == whole
    assert state(IX.merge(spark, path)) == whole and all(len(p) == 1 for p in Store(spark, path).manifest()["tables"].values())
    q = spark.createDataFrame([(1, "chỉ7 word1")], "qid int, query string")
    assert [r.id for r in IX.search(IX.read(spark, path), q, 2).collect()] == [7, 1]


def test_hot_terms_go_over_files(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(IX, "HOT_ROWS", 3)
    assert state(IX.build(table(spark, range(20)), str(tmp_path))) == whole


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.commit({}, None, {"kind": "x"})
    store.commit({}, first)
    with pytest.raises(Conflict):
        store.commit({}, first)
    assert store.versions() == [1, 2]
    with pytest.raises(FileNotFoundError):
        IX.read(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        VX.read(spark, str(tmp_path / "nothing"))


def test_state_of_files(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).coalesce(1).write.parquet(str(path))
    was = shared.state(spark, str(path))
    part = next(path.glob("part-*.parquet"))
    other = tmp_path / "u"
    spark.range(50).coalesce(1).write.parquet(str(other))
    part.write_bytes(next(other.glob("part-*.parquet")).read_bytes())  # a file rewritten in place
    assert shared.state(spark, str(path)) != was and shared.state(spark, str(path)) == shared.state(spark, str(path))
    assert shared.state(spark, str(part)) == shared.state(spark, str(part))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(2000, [0.0] * 16), (2001, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


def test_vector_index(spark, tmp_path, clustered):
    path = str(tmp_path / "v")
    VX.build(clustered.filter("id % 3 = 0"), path)
    for _ in range(2):
        ix = VX.append(clustered, path, batch=("b", 4))
    assert ix.documents.count() == ix.vectors.count() == 1502 and ix.config["lists"] == 22
    q = clustered.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    exact = V.vector_search(clustered, q, 10)
    few = VX.recall(VX.search(ix, q, 10, probes=5), exact).agg(F.sum("found"), F.sum("expected")).first()
    assert few[0] >= 0.9 * few[1]
    rounded = [F.col("qid"), F.col("id"), F.round("score", 8), F.col("rank")]
    assert sorted(map(tuple, VX.search(ix, q, 10, probes=22).select(*rounded).collect())) == sorted(map(tuple, exact.select(*rounded).collect()))
    assert VX.search(ix, q.limit(0), 10).count() == 0


def test_vector_index_edges(spark, tmp_path, clustered):
    empty = VX.build(clustered.limit(0), str(tmp_path / "e"))
    q = clustered.limit(2).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    assert empty.config["lists"] == 0 and empty.vectors.count() == 0
    path = str(tmp_path / "s")
    clustered.filter("id < 40").write.parquet(str(tmp_path / "src"))
    VX.build(clustered.filter("id < 10"), path)
    for ck in ("a", "b"):
        stream = spark.readStream.schema("id long, v array<double>").parquet(str(tmp_path / "src"))
        events.incremental_vectors(stream, path, str(tmp_path / ck)).awaitTermination()
    assert sorted(r.id for r in VX.read(spark, path).documents.collect()) == list(range(40)) and q.count() == 2
