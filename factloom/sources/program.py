"""The tables of a built program, with the guards on what may be extracted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators.links import missing
from .schema import PROGRAM


class ProgramError(Exception):
    """The tables don't describe a program that can be extracted."""


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of the program that is in the folder, as Parquet, with its schema; missing ones are empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        raise ProgramError(f"{folder} is not there")
    out = {}
    for name, ddl in PROGRAM.items():
        there = fs.exists(path(f"{folder}/{name}.parquet"))
        out[name] = spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet") if there else spark.createDataFrame([], ddl)
    return out


def mock_files(files: DataFrame) -> DataFrame:
    """Files named as mocks or with a mock generator's header."""
    return files.where(classify.mock_file_name(F.col("file")) | F.coalesce(F.exists("header_comments", classify.mock_header), F.lit(False))).select("file").distinct()


def mock_packages(packages: DataFrame, files: DataFrame, segments=classify.MOCK_SEGMENTS) -> DataFrame:
    """Packages on a mock path, with a mock_ segment or name, or all of whose files but tests are mocks."""
    mocks = mock_files(files).withColumn("mock", F.lit(True))
    real = files.where(~classify.test_file(F.col("file"))).join(mocks, "file", "left")
    only = real.groupBy("pkg_path").agg(F.bool_and(F.coalesce("mock", F.lit(False))).alias("only_mocks"))
    path = F.col("pkg_path")
    named = classify.mock_path(path, segments) | F.exists(F.split(path, "/"), lambda s: s.startswith("mock_")) | F.coalesce(F.col("name").startswith("mock_"), F.lit(False))
    return packages.join(only, "pkg_path", "left").where(named | F.coalesce("only_mocks", F.lit(False))).select("pkg_path").distinct()


def dependencies(packages: DataFrame, mocks: DataFrame) -> DataFrame:
    return packages.where("NOT in_scope AND module_path IS NOT NULL AND module_path != ''").join(mocks, "pkg_path", "left_anti")


def emittable(functions: DataFrame, packages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Functions with a body in a package in scope, not in an excluded file; without a package, instances and synthetic ones."""
    scope = packages.where("in_scope").select("pkg_path").withColumn("__in", F.lit(True))
    f = functions.join(scope, "pkg_path", "left").join(excluded.select("file").distinct(), "file", "left_anti")
    loose = F.col("pkg_path").isNull() & (classify.instance_like(F.col("type_args")) | (F.coalesce("synthetic", F.lit("")) != ""))
    return f.where(F.col("has_body") & (F.coalesce("__in", F.lit(False)) | loose)).drop("__in")


def guard(packages: DataFrame, requested: list[str], dropped: DataFrame | None = None, allow_missing: bool = False) -> None:
    """Raises if nothing matched, if most packages have errors, or if a package asked for by name was never built."""
    n = packages.where("in_scope").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("n_errors") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    if not n["n"]:
        raise ProgramError(f"nothing matched {', '.join(requested)}")
    if 2 * n["bad"] > n["n"]:
        raise ProgramError(f"{n['bad']} of {n['n']} packages have errors")
    spark = packages.sparkSession
    asked = spark.createDataFrame([(r,) for r in requested], "pkg_path string")
    known = [packages.where("has_ssa").select("pkg_path")] + ([dropped.select("pkg_path")] if dropped is not None else [])
    lost = [r["pkg_path"] for r in missing(asked, *known, key="pkg_path").orderBy("pkg_path").limit(4).collect()]
    if lost and not allow_missing:
        raise ProgramError(f"never built: {', '.join(lost[:3])}{' ...' if len(lost) > 3 else ''}")


def toolchain_guard(errors: DataFrame) -> None:
    """Raises if a package (pkg_path, message) needs a newer toolchain: every package fails then, and little would be extracted."""
    skew = errors.where(F.col("message").contains("requires newer Go version")).orderBy("pkg_path", "message").limit(1).collect()
    if skew:
        raise ProgramError(f"toolchain skew: {skew[0]['pkg_path']}: {skew[0]['message']}")


def stale_checkout(commits: DataFrame, head: str) -> str:
    """A warning if the commit that was read isn't ``head``, a full id; empty otherwise or if none is known."""
    row = commits.select("commit_sha").limit(1).collect()
    now = row[0]["commit_sha"] if row else ""
    return f"warning: the tables are of {now[:8]}, not of head {head[:8]}" if now and head and now != head else ""


def has_grpc_server(types: DataFrame) -> bool:
    return not types.where(classify.grpc_server_type(F.col("name"))).isEmpty()


def module_map(packages: DataFrame) -> DataFrame:
    return packages.where("module_path IS NOT NULL AND module_path != ''").select("pkg_path", "module_path").distinct()


def manifest(functions: DataFrame, diff: DataFrame, base: str, head: str, mode: str = "mr") -> DataFrame:
    """One row with a JSON manifest of the functions (iid, bid, fqn, file) in files that changed between two commits."""
    files = diff.where((F.col("base") == base) & (F.col("head") == head)).select("file").distinct()
    hit = functions.join(files, "file", "left_semi")
    fns = hit.agg(F.array_sort(F.collect_list(F.struct("fqn", "iid", "bid", "file"))).alias("fns"))
    names = files.agg(F.array_sort(F.collect_list("file")).alias("files"))
    ordered = F.transform("fns", lambda f: F.struct(f["iid"].alias("iid"), f["bid"].alias("bid"), f["fqn"].alias("fqn"), f["file"].alias("file")))
    both = fns.withColumn("k", F.lit(1)).join(names.withColumn("k", F.lit(1)), "k")
    return both.select(F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(base).alias("base"), F.lit(head).alias("head"), F.col("files").alias("changed_files"), ordered.alias("changed_fns"))).alias("manifest"))
