"""Stored vector index: an inverted file of lists around centroids, behind one manifest.

Centroids are fitted by Lloyd's rounds on unit vectors, over at most ``SAMPLE``
rows of the least id hashes; every row is indexed, in the list of its nearest
centroid.  ``vectors`` (list, id, v) lies in one folder for each list,
``centroids`` (list, v) is small, ``documents`` (id) says what is indexed, and
the manifest holds width, lists, metric and counts.  All of it is staged first
and committed last, so that rows and metadata never disagree.

A search takes a stated set of queries, in blocks of bounded bytes: each query
looks at the ``probes`` lists of its nearest centroids, and the scan reads the
folders of those lists only.  With as many probes as lists it is exact; that is
also what a query without a direction (a zero or null vector) gets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import retrieval as V
from lexloom.sources.versions import Store

#: Rows that centroids are fitted on, rounds of the fit, and the most lists.
SAMPLE, ROUNDS, MOST_LISTS = 65_536, 6, 4096


@dataclass
class VectorIndex:
    vectors: DataFrame
    documents: DataFrame
    centroids: np.ndarray
    config: dict


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T, axis=1) if len(centroids) else np.zeros(len(x), int)


def fit(vectors: DataFrame, lists: int, width: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of (id, v): Lloyd's rounds in Spark over the sampled rows, from rows spread over their hashes."""
    spark = vectors.sparkSession
    held = vectors.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) > 0).withColumn("h", F.xxhash64("id"))
    n = held.count()
    if n > sample:
        held = held.filter(F.col("h") <= F.lit(int(-(2**63) + 2**64 * sample / n)))  # hashes are uniform: about so many rows, at any size
    first = held.orderBy("h", "id").limit(lists).select("v").toArrow()
    centroids = V._unit_rows(first.column("v"), width)
    held = held.select("v").persist()
    try:
        for _ in range(rounds):
            now = spark.sparkContext.broadcast(centroids)

            def go(batches, now=now):
                c = now.value
                sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
                for batch in batches:
                    x = V._unit_rows(batch.column("v"), width)
                    at = _nearest(x, c)
                    np.add.at(sums, at, x)
                    n += np.bincount(at, minlength=len(c))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["list", "s"])

            # A row for each list and task: bounded by the sample.
            got = held.mapInArrow(go, "list long, s array<double>").toArrow()
            total = np.zeros_like(centroids)
            if got.num_rows:
                np.add.at(total, got.column("list").to_numpy(), np.stack(got.column("s").to_numpy()))
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centroids)  # a list without rows keeps its place
    finally:
        held.unpersist()
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(list, id, v): every row in the list of its nearest centroid; vectors of another width are an error."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def go(batches):
        for batch in batches:
            at = _nearest(V._unit_rows(batch.column("v"), width), held.value)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("id"), batch.column("v")], names=["list", "id", "v"])

    return vectors.mapInArrow(go, f"list int, id {dict(vectors.dtypes)['id']}, v array<double>")


def _stage(rows: DataFrame, store: Store, centroids: np.ndarray, width: int) -> dict[str, str]:
    placed = assigned(rows, centroids, width)
    parts = {"vectors": store.stage("vectors", placed, by="list")}
    parts["documents"] = store.stage("documents", store.staged(parts["vectors"]).select("id"))
    return parts


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "v", lists: int | None = None, batch: tuple[str, int] | None = None) -> VectorIndex:
    """Commit the index of all rows as the next version: lists about the square root of the rows, one row for each id."""
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    twice = rows.groupBy("id").count().filter("count > 1")
    rows = rows if twice.isEmpty() else rows.dropDuplicates(["id"])
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, 0)
    centroids = fit(rows, lists or min(MOST_LISTS, max(1, int(n**0.5))), width) if n else np.zeros((0, width))
    store = Store(spark, path)
    before = store.manifest()
    parts = _stage(rows, store, centroids, width)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, v array<double>")
    parts["centroids"] = store.stage("centroids", table)
    store.commit(parts, before, {"kind": "vectors", "metric": "cosine", "width": width, "lists": len(centroids)}, batch, replace=True)
    return read(spark, path)


def append(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "v", batch: tuple[str, int] | None = None) -> VectorIndex:
    """Add the rows whose id is not there, in the lists of the centroids that are; a second append, or the same batch, adds nothing."""
    spark = vectors.sparkSession
    now = read(spark, path)
    store = Store(spark, path)
    before = store.manifest()
    if batch and before["batches"].get(batch[0], -1) >= batch[1]:
        return now
    new = _rows(vectors, id_col, vector_col).dropDuplicates(["id"]).join(now.documents, "id", "left_anti").select("id", "v")
    store.commit(_stage(new, store, now.centroids, before["config"]["width"]), before, batch=batch)
    return read(spark, path)


def read(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """Open a version; a folder without a manifest, or whose metadata do not fit its tables, is an error."""
    store = Store(spark, path)
    manifest = store.manifest(version)
    if manifest is None or manifest["config"].get("kind") != "vectors":
        raise FileNotFoundError(f"no vector index at {path}")
    config = manifest["config"]
    rows = store.table("centroids", manifest).orderBy("list").toArrow()  # MOST_LISTS rows at most
    centroids = np.array(rows.column("v").to_pylist(), float).reshape(rows.num_rows, config["width"] if rows.num_rows else 0)
    if len(centroids) != config["lists"]:
        raise ValueError(f"{path}: {len(centroids)} centroids, the manifest says {config['lists']}")
    return VectorIndex(store.table("vectors", manifest), store.table("documents", manifest), centroids, config)


def probes_of(index: VectorIndex, share: float = 0.7) -> int:
    """Lists to probe: ``share`` of them, since vectors without clusters have near neighbours in most lists; far fewer do for clustered ones."""
    return max(1, int(np.ceil(share * len(index.centroids))))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 16) -> DataFrame:
    """(qid, id, score, rank) of (qid, qv) by cosine over the probed lists; ties by id."""
    spark = queries.sparkSession
    width, lists = index.config["width"], len(index.centroids)
    size = max(1, V.BROADCAST_BYTES // (8 * max(1, width)))
    blocks = -(-queries.count() // size) or 1
    dealt = queries.select("qid", "qv").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    types = dict(queries.dtypes), dict(index.vectors.dtypes)
    out = None
    for b in range(blocks):
        got = dealt.filter(F.col("block") == b).toArrow()
        q = V._unit_rows(got.column("qv"), width)
        near = q @ index.centroids.T if lists else np.zeros((len(q), 0))
        probed = np.zeros(near.shape, bool)
        if lists:
            many = min(probes, lists)
            np.put_along_axis(probed, np.argpartition(-near, many - 1, axis=1)[:, :many], True, axis=1)
            probed[~q.any(1)] = True
        held = spark.sparkContext.broadcast((got.column("qid").to_pylist(), q, probed))
        kind = got.schema.field("qid").type

        def go(batches, held=held, kind=kind):
            names, q, probed = held.value
            for batch in batches:
                x = V._unit_rows(batch.column("v"), width)
                at = batch.column("list").to_numpy()
                ids = batch.column("id")
                for one in np.unique(at):
                    rows, mine = np.flatnonzero(at == one), np.flatnonzero(probed[:, one])
                    if not len(mine):
                        continue
                    s = x[rows] @ q[mine].T
                    r, c = V._best(s, ids.take(pa.array(rows)).to_numpy(zero_copy_only=False), k)
                    yield pa.RecordBatch.from_arrays([pa.array([names[mine[j]] for j in c.tolist()], kind), ids.take(pa.array(rows[r])), pa.array(s[r, c])], names=["qid", "id", "score"])

        scan = index.vectors.select("list", "id", "v")
        wanted = np.flatnonzero(probed.any(0)).tolist()
        if len(wanted) < lists:
            scan = scan.filter(F.col("list").isin(wanted))
        part = V.top_k(scan.mapInArrow(go, f"qid {types[0]['qid']}, id {types[1]['id']}, score double"), k)
        out = part if out is None else out.unionByName(part)
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, found, expected): how many of the exact hits a search returned; a hit as good as the last exact one counts too."""
    last = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("expected"), F.min(F.round("score", 9)).alias("least"))
    good = found.join(last.select("qid", "least"), "qid").filter(F.round("score", 9) >= F.col("least")).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    return last.join(good, "qid", "left").select("qid", F.coalesce("found", F.lit(0)).alias("found"), "expected")
