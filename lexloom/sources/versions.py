"""Tables of an index behind one manifest that is written last.

A store is a folder: ``data`` holds folders of rows that are never changed, and
``manifests`` one small JSON file for each version, which lists the folders of
every table.  A writer stages its folders first and commits by renaming a whole
manifest to the next number; readers open the highest number.  What a writer
staged before it failed is in no manifest, so a second attempt starts from the
same version as the first.  An append may name its batch (a source and a number
that only grows): the manifest keeps the last number of every source, and a
batch that is in it already is not added again.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas: dict[str, dict] = {}
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, else of the last one; none if nothing was committed."""
        found = self.versions()
        if version is None and not found:
            return None
        stream = self.fs.open(self._at(f"manifests/{found[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, table: str, rows: DataFrame, by: str | None = None) -> str:
        """Write rows to a new folder, which belongs to nothing until a commit lists it."""
        name = f"data/{table}-{uuid.uuid4().hex}"
        self.schemas[name] = rows.schema.jsonValue()
        out = rows.write.option("compression", "zstd")
        if "id" in rows.columns and isinstance(rows.schema["id"].dataType, ArrayType):
            out = out.option("parquet.enable.dictionary#id.list.element", "false")  # ids of a list repeat too little
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}")
        return name

    def staged(self, name: str) -> DataFrame:
        return self._read(name, self.schemas[name])

    def _read(self, name: str, schema: dict) -> DataFrame:
        """A folder may be empty: its schema comes from who wrote it."""
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def commit(self, parts: dict[str, str], before: dict | None, config: dict | None = None, batch: tuple[str, int] | None = None, replace: bool = False) -> dict:
        """The next version: ``before`` with one more folder for each table, or these folders alone."""
        now = datetime.now(UTC).isoformat(timespec="seconds")
        old = before or {"version": 0, "created_at": now, "config": {}, "tables": {}, "batches": {}}
        kept = {} if replace else old["tables"]
        new = {
            "version": old["version"] + 1, "commit": uuid.uuid4().hex, "created_at": old["created_at"], "updated_at": now, "config": config or old["config"],
            "schemas": {**({} if replace else old.get("schemas", {})), **{t: self.schemas[p] for t, p in parts.items()}},
            "tables": {t: [*kept.get(t, []), *([parts[t]] if t in parts else [])] for t in {**kept, **parts}}, "batches": {**({} if replace else old["batches"]), **({batch[0]: batch[1]} if batch else {})},
        }
        temp, final = self._at(f"manifests/.{new['commit']}"), self._at(f"manifests/{new['version']:012d}.json")
        self.fs.mkdirs(self._at("manifests"))
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(temp, final) or self.manifest(new["version"])["commit"] != new["commit"]:
            self.fs.delete(temp, False)
            raise Conflict(f"version {new['version']} of {self.path} was committed by another writer")
        return new

    def table(self, name: str, manifest: dict) -> DataFrame:
        parts = [self._read(p, manifest["schemas"][name]) for p in manifest["tables"][name]]
        out = parts[0]
        for p in parts[1:]:  # a folder has its own partition column, so each is a table of its own
            out = out.unionByName(p)
        return out

    def vacuum(self) -> list[str]:
        """Delete what no version lists; only while nobody writes."""
        listed = {p for v in self.versions() for parts in self.manifest(v)["tables"].values() for p in parts}
        folder = self._at("data")
        found = [f"data/{s.getPath().getName()}" for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        gone = [p for p in found if p not in listed]
        for p in gone:
            self.drop(p)
        return gone
