"""Snapshots of dispatch: a validated store keyed by every option that shapes the result.

A snapshot is a folder per commit under a folder per key: Parquet tables, and a ``meta`` table, written last, with the digest of
each table's files. It appears by one rename, and only a whole, matching snapshot is ever a hit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sanitize
from ..options import Options

VERSION = 1
KEPT_COMMITS = 8


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, options: Options):
        self.spark, self.options = spark, options
        self.key = options.key()
        self.folder = f"{root.rstrip('/')}/{options.repo.replace('/', '_') or 'repo'}-{self.key[:12]}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _digests(self, folder: str) -> DataFrame:
        """table, sha256 over its files in order of name; files are hashed by the tasks."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
        each = files.select(F.element_at(F.split("path", "/"), -2).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("h"))
        return each.groupBy("table").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "h"))), lambda x: x["h"]), ","), 256).alias("sha256"))

    def write(self, commit: str, tables: dict[str, DataFrame], parent: str = "", fn_set_hash: str = "") -> None:
        if not commit:
            raise ValueError("a snapshot needs a commit")
        draft = f".tmp-{commit[:12]}-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.folder}/{draft}/{name}")
            shards = [(r["table"], r["sha256"]) for r in self._digests(f"{self.folder}/{draft}").collect()]
            meta = [(VERSION, commit, parent, self.options.dispatch, self.options.cap, fn_set_hash, shards)]
            spec = "version int, commit_sha string, parent_sha string, mode string, cap int, fn_set_hash string, shards array<struct<table: string, sha256: string>>"
            self.spark.createDataFrame(meta, spec).coalesce(1).write.parquet(f"{self.folder}/{draft}/meta")
            final, aside = self._path(commit[:12]), self._path(f".tmp-old-{uuid.uuid4().hex}")
            # an older one of the commit steps aside, and comes back if the new one can't be put in place
            had = self._fs.exists(final) and self._fs.rename(final, aside)
            if not self._fs.rename(self._path(draft), final):
                if had:
                    self._fs.rename(aside, final)
                raise RuntimeError(f"the snapshot of {commit} could not be put in place")
            if had:
                self._fs.delete(aside, True)
        finally:
            self._fs.delete(self._path(draft), True)
        self._keep_newest()

    def probe(self, commit: str) -> tuple[dict[str, DataFrame] | None, str]:
        """(tables, "") or (None, why not)."""
        if not commit:
            return None, "no commit"
        folder = f"{self.folder}/{commit[:12]}"
        if not self._fs.exists(self._path(f"{commit[:12]}/meta/_SUCCESS")):
            return None, "no snapshot"
        try:
            meta = self.spark.read.parquet(f"{folder}/meta").first()
        except Exception:
            return None, "meta corrupt"
        if meta is None or (meta["version"], meta["commit_sha"], meta["mode"], meta["cap"]) != (VERSION, commit, self.options.dispatch, self.options.cap):
            return None, "meta mismatch"
        now = {r["table"]: r["sha256"] for r in self._digests(folder).where("table != 'meta'").collect()}
        for table, sha in meta["shards"]:
            if table not in now:
                return None, f"shard missing: {table}"
            if now[table] != sha:
                return None, f"shard hash mismatch: {table}"
        return {table: self.spark.read.parquet(f"{folder}/{table}") for table, _ in meta["shards"]}, ""

    def fn_set_hash(self, commit: str) -> str:
        return self.spark.read.parquet(f"{self.folder}/{commit[:12]}/meta").first()["fn_set_hash"]

    def _keep_newest(self) -> None:
        there = [s for s in self._fs.listStatus(self._hadoop.Path(self.folder)) if s.isDirectory() and not s.getPath().getName().startswith(".tmp-")]
        for s in sorted(there, key=lambda s: -s.getModificationTime())[KEPT_COMMITS:]:
            self._fs.delete(s.getPath(), True)


def replay_or_build(store: SnapshotStore | None, commit: str, dirty: bool, fn_set_hash: str, build, functions: DataFrame, calls: DataFrame, externals: DataFrame) -> tuple[dict[str, DataFrame], str]:
    """A snapshot's tables if they still fit the program, else ``build()``'s, which are stored. The second value says what happened.

    ``edges`` of a snapshot has caller, ordinal, callee and n_calls. Without a commit, or on changed files, nothing is stored.
    """
    from ..operators.links import rebind_errors

    if store is None or dirty or not commit:
        return build(), "bypassed"
    tables, why = store.probe(commit)
    if tables is not None and store.fn_set_hash(commit) != fn_set_hash:
        tables, why = None, "function set changed"
    if tables is not None:
        wrong = [r["check"] for r in rebind_errors(tables["edges"], functions, calls, externals).where("n > 0").collect()]
        if not wrong:
            return tables, "replayed"
        why = wrong[0]
    tables = build()
    store.write(commit, tables, fn_set_hash=fn_set_hash)
    return tables, f"{why} - rebuilt"


def package_shards(callers: DataFrame, types: DataFrame, ifaces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pkg, callers, types, ifaces, pairs): what a snapshot stores for each package; every input has pkg besides its own columns."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        own = [F.col(c) for c in df.columns if c != "pkg"]
        return df.groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))

    out = gathered(callers, "callers")
    for df, name in ((types, "types"), (ifaces, "ifaces"), (pairs, "pairs")):
        out = out.join(gathered(df, name), "pkg", "full")
    return out


def shard_name(package: str):
    return F.concat(sanitize(package), F.lit(".pb"))
