"""Measures what the first two steps of a full difference-cover suffix sort would move; no test.

    python tests/llm/trial_difference_cover.py [folder with documents.parquet]

Per modulus v: every sampled position sends its tuple of v bytes with its place
to a range-partitioned sort (step 1), and its rank goes back to its document in
order of position (step 2, what a recursion on names reads).  Shuffled bytes
are compressed with zstd, as on a cluster that saves disk.  Recursion and the
merge of the other suffixes would come on top.
"""

import os
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
COVERS = {3: (1, 2), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def tuples(v):
    cover = COVERS[v]

    def go(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                at = np.sort(np.concatenate([np.arange(d, len(data), v) for d in cover])).astype(np.int32)
                if not len(at):
                    continue
                padded = np.concatenate([data, np.zeros(v, np.uint8)])
                t = padded[at[:, None] + np.arange(v)].reshape(-1)
                col = pa.FixedSizeBinaryArray.from_buffers(pa.binary(v), len(at), [None, pa.py_buffer(t.tobytes())]).cast(pa.binary())
                yield pa.record_batch([col, pa.array(np.full(len(at), doc)), pa.array(at)], names=["t", "doc_id", "pos"])

    return go


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "64").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.io.compression.codec", "zstd").config("spark.sql.adaptive.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").repartition(16).cache()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    for v in COVERS:
        rows = docs.mapInArrow(tuples(v), "t binary, doc_id long, pos int")
        before, began = written(), time.time()
        ranked = rows.repartitionByRange(64, "t").sortWithinPartitions("t").select("doc_id", "pos", (F.monotonically_increasing_id()).alias("rank"))
        ranked.write.format("noop").mode("overwrite").save()
        step1, at = written() - before, time.time()
        names = ranked.repartition(64, "doc_id").sortWithinPartitions("doc_id", "pos")
        before = written()
        names.write.format("noop").mode("overwrite").save()
        step2 = written() - before - step1
        print(f"v = {v}: input {size / 1e6:.1f} MB; sorting tuples {step1 / size:.2f} x the input, {at - began:.0f} s; ranks back to places {step2 / size:.2f} x, {time.time() - at:.0f} s", flush=True)


if __name__ == "__main__":
    main()
