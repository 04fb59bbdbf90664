"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. A shard's tier is the number of times that its size can be divided
by the fan-in before it is below the smallest run; once a tier holds as many shards as the fan-in, they are merged into files
of the target size. Shards that have reached the target stay as they are, so every row is written a few times at most.
A merge reads its runs and coalesces them, without a shuffle.

The state is a manifest, a JSON list of shards with their sizes and tiers. Version n + 1 is claimed by creating a file that must not
be there yet, written beside the others and renamed to its final name; readers see one whole version or the next. The newest ``keep``
versions stay readable: an older manifest is deleted first, then the shards that only it named. A writer that dies leaves at
most a claim, which :meth:`Store.release` takes back, and files that no manifest names. All file operations go through Hadoop's file system, so the store may lie anywhere that Spark can write.

Defined results: rows are kept exactly as they are, with all columns, nulls and repeats; an empty table has no shards.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, shared_dir

#: Bytes of a finished shard, the fan-in of merges, the bytes of the smallest run.
TARGET, FAN_IN, SMALLEST = 32 << 20, 8, 256 << 10
#: Versions that stay readable.
KEEP = 8
#: Arrivals that a batch load is split into.
ARRIVALS = 8


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN, smallest: int = SMALLEST, keep: int = KEEP):
        self.spark, self.root, self.target, self.fan_in, self.smallest, self.keep = spark, root.rstrip("/"), target, fan_in, smallest, max(1, keep)
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        there = self._path("manifests")
        if not self.fs.exists(there):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(there)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, shards: [{name, bytes, tier}], schema}; the newest version unless one is named."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        stream = self.fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, before: dict, shards: list[dict], schema: str) -> dict:
        after = {"version": before["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["name"])}
        draft, final, claim = (self._path(f"manifests/{n}") for n in (f".draft-{uuid.uuid4().hex}", f"v{after['version']:08d}.json", f".claim-{after['version']:08d}"))
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            raise RuntimeError(f"version {after['version']} is claimed by another writer") from e
        if self.fs.exists(final):
            raise RuntimeError(f"version {after['version']} was committed by another writer")
        out = self.fs.create(draft)
        out.write(json.dumps(after).encode())
        out.close()
        if not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {after['version']} could not be committed")
        self._expire()
        return after

    def release(self, version: int) -> None:
        """Takes back the claim of a writer that died before its commit."""
        if version not in self.versions():
            self.fs.delete(self._path(f"manifests/.claim-{version:08d}"), False)

    def _expire(self) -> None:
        """Deletes versions beyond the newest ``keep``, and the shards that only they name."""
        versions = self.versions()
        old, new = versions[: -self.keep], versions[-self.keep :]
        if not old:
            return
        named = {s["name"] for v in new for s in self.manifest(v)["shards"]}
        for v in old:
            gone = {s["name"] for s in self.manifest(v)["shards"]} - named
            self.fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
            for n in sorted(gone):
                self.fs.delete(self._path(n), False)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(1.0, size / self.smallest), self.fan_in)))

    def _shards_in(self, folder: str) -> list[dict]:
        """The data files of a folder that Spark has written."""
        if not self.fs.exists(self._path(folder)):
            return []
        files = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder))]
        return [{"name": f"{folder}/{n}", "bytes": size, "tier": self.tier(size)} for n, size in sorted(files) if n.startswith("part-")]

    def append(self, rows: DataFrame, arrivals: int = 1, compact: bool = True) -> dict:
        """Appends ``rows`` as ``arrivals`` batches from one scan, each committed by itself and followed by compaction."""
        name = f"data/a-{uuid.uuid4().hex}"
        schema = rows.schema.json()
        if self.manifest()["schema"] not in (None, schema):
            raise ValueError("the rows' schema isn't that of the store")
        if arrivals > 1:
            # a row's arrival hangs on its contents alone, so a task that runs again writes the same shards
            key = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(arrivals))
            (arrival,) = fresh(rows, "arrival")
            rows.withColumn(arrival, key).write.partitionBy(arrival).parquet(f"{self.root}/{name}")
            folders = [f"{name}/{arrival}={k}" for k in range(arrivals)]
        else:
            rows.write.parquet(f"{self.root}/{name}")
            folders = [name]
        state = self.manifest()
        for folder in folders:
            state = self._commit(state, state["shards"] + self._shards_in(folder), schema)
            if compact:
                state = self.compact()
        return state

    def compact(self) -> dict:
        """Merges tiers until none holds as many shards below the target size as the fan-in."""
        state = self.manifest()
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in state["shards"]:
                if s["bytes"] < self.target * 3 // 4:
                    tiers.setdefault(s["tier"], []).append(s)
            full = [t for t, s in tiers.items() if len(s) >= self.fan_in]
            if not full:
                return state
            runs = tiers[min(full)]
            files = max(1, round(sum(s["bytes"] for s in runs) / self.target))
            if files >= len(runs):
                return state
            folder = f"data/m-{state['version'] + 1:08d}-{uuid.uuid4().hex}"
            self._read(runs, state).coalesce(files).write.parquet(f"{self.root}/{folder}")
            gone = {s["name"] for s in runs}
            merged = self._shards_in(folder)
            for s in merged:  # so that a merge always leads upwards
                s["tier"] = max(s["tier"], min(full) + 1)
            state = self._commit(state, [s for s in state["shards"] if s["name"] not in gone] + merged, state["schema"])

    def _read(self, shards: list[dict], state: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(state["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['name']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        if version is not None and version not in self.versions():
            raise ValueError(f"version {version} isn't there, or not any more")
        state = self.manifest(version)
        if state["schema"] is None:
            raise ValueError("the store is empty")
        return self._read(state["shards"], state)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Where each document lies after its arrival and compaction: doc_id, shard, shard_bytes, tier, version."""
    store = Store(spark, f"{shared_dir(spark)}/shards")
    state = store.append(documents(spark, sf_dir), arrivals=ARRIVALS)
    shards = [(f"s{k:05d}", s["name"].rsplit("/", 1)[1], s["bytes"], s["tier"], state["version"]) for k, s in enumerate(state["shards"])]
    # one row for each file of the manifest, which the driver holds anyway
    listed = spark.createDataFrame(shards, "shard string, __file string, shard_bytes long, tier int, version int")
    rows = store.read().select("doc_id", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("__file"))
    return rows.join(listed, "__file").select("doc_id", "shard", "shard_bytes", "tier", "version")
