"""Package facts as files: one message per package, read into nested rows and written back.

Reading distributes files over tasks and decodes them there; the nested rows are then exploded into flat tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sanitize
from . import schema, wire


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The packages in a file, or in the ``*.pb`` files of a folder; damaged files raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pb").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([wire.decode("Package", c) for c in batch["content"]])

    return files.mapInPandas(run, schema.ddl("Package"))


def write_packages(packages: DataFrame, folder: str) -> DataFrame:
    """One file per package, named by its sanitised path; fields in order, so equal facts give equal bytes.

    The files are written by the tasks through Spark's own binary rows: the result has name and content, and ``folder`` gets
    them as Parquet, which :func:`export` turns into plain files.
    """
    columns = [F.col(n) for _, n, _, _ in schema.MESSAGES["Package"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            yield pd.DataFrame({"name": batch["__name"], "content": [wire.encode("Package", _plain(r)) for r in rows]})

    named = packages.select(*columns, F.concat(sanitize(F.col("package_path")), F.lit(".pb")).alias("__name"))
    out = named.mapInPandas(run, "name string, content binary")
    out.write.mode("overwrite").parquet(folder)
    return packages.sparkSession.read.parquet(folder)


def _plain(value):
    """Arrow's arrays and numpy scalars as plain Python values."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, (bytes, str)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and value != value else value


def export(spark: SparkSession, written: DataFrame, folder: str) -> int:
    """Puts the contents of :func:`write_packages` into plain files, through Hadoop, one package at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for row in written.select("name", "content").toLocalIterator():
        out = fs.create(path(f"{folder.rstrip('/')}/{row['name']}"), True)
        out.write(bytearray(row["content"]))
        out.close()
        n += 1
    return n


def functions(packages: DataFrame) -> DataFrame:
    return packages.select("repo", "package_path", F.explode("functions").alias("f")).select("repo", "package_path", "f.*")


def call_sites(packages: DataFrame) -> DataFrame:
    fn = functions(packages).select("package_path", F.col("id.iid").alias("fn_iid"), "fqn", F.explode("flow.callsites").alias("s"))
    return fn.select("package_path", "fn_iid", "fqn", "s.*")


def vertices(packages: DataFrame) -> DataFrame:
    fn = functions(packages).select("package_path", F.col("id.iid").alias("fn_iid"), F.explode("flow.vertices").alias("v"))
    return fn.select("package_path", "fn_iid", "v.*")


def edges(packages: DataFrame) -> DataFrame:
    fn = functions(packages).select("package_path", F.col("id.iid").alias("fn_iid"), F.explode("flow.edges").alias("e"))
    return fn.select("package_path", "fn_iid", "e.*")


def site_lines(packages: DataFrame) -> DataFrame:
    """fqn, site, opaque, confidence and callees of every site, separated by tabs."""
    callees = F.array_join(F.transform("callee_iids", lambda c: F.lower(F.hex(c))), ",")
    return call_sites(packages).select("fqn", "id", F.concat_ws("\t", "fqn", F.col("id").cast("string"), F.col("opaque").cast("string"), F.format_string("%.4f", F.col("dispatch_confidence")), callees).alias("line"))


def function_lines(packages: DataFrame, contains: str = "") -> DataFrame:
    """Functions with their sites, of those whose name contains the text."""
    s = call_sites(packages).where(F.col("fqn").contains(contains))
    return s.select("fqn", "id", F.format_string("%s  cs%d %s %s argc=%d resultc=%d conf=%.4f", "fqn", "id", "kind", "callee_fqn", "argc", "resultc", F.col("dispatch_confidence").cast("double")).alias("line"))


def contract_lines(packages: DataFrame) -> DataFrame:
    """ENDPOINT, GRPC, GRAPHQL and HTTP contracts with their handlers' names."""
    fn = functions(packages).select(F.col("id.iid").alias("__iid"), F.col("fqn").alias("handler")).dropDuplicates(["__iid"])

    def part(kind: str, column: str, name: str, handler: str | None) -> DataFrame:
        rows = packages.select("package_path", F.explode(column).alias("c"))
        return rows.select("package_path", F.lit(kind).alias("kind"), F.col(f"c.{name}").alias("name"), (F.col(f"c.{handler}") if handler else F.lit(None).cast("binary")).alias("__h"))

    rows = part("ENDPOINT", "endpoints", "name", None)
    for p in (("GRPC", "grpc_methods", "full_name", "handler_iid"), ("GRAPHQL", "graphql_fields", "type_field", "resolver_iid"), ("HTTP", "http_routes", "path", "handler_iid")):
        rows = rows.unionByName(part(*p))
    return rows.join(fn, F.col("__h") == F.col("__iid"), "left").select("package_path", "kind", "name", F.coalesce("handler", F.lit("")).alias("handler"))


def statistics(packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals, histogram of callees per site, histogram of confidences."""
    from ..operators import census

    s = call_sites(packages)
    totals = packages.agg(F.count("*").alias("shards"), F.coalesce(F.sum(F.size("functions")), F.lit(0)).alias("functions")).withColumn("k", F.lit(1))
    sites = s.agg(F.count("*").alias("sites"), F.count_if("opaque").alias("opaque")).withColumn("k", F.lit(1))
    return totals.join(sites, "k").drop("k"), census.fanout_histogram(s, "callee_iids").orderBy("fanout"), census.confidence_histogram(s, "dispatch_confidence").orderBy("confidence")
