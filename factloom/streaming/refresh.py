"""Fact tables that follow a folder of package facts: each new file replaces its package.

Files are read as a stream; every batch is decoded and written under its number, so a batch that runs again writes the same
folder again. The newest batch that has a package wins when the tables are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schema, wire


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pb").load(folder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**wire.decode("Package", c), "modified": m} for c, m in zip(batch["content"], batch["modificationTime"])]
            yield pd.DataFrame(rows, columns=[n for _, n, _, _ in schema.MESSAGES["Package"]] + ["modified"])

    def write(batch: DataFrame, number: int) -> None:
        batch.select("content", "modificationTime").mapInPandas(decode, schema.ddl("Package") + ", modified timestamp").write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest state of every package."""
    rows = spark.read.schema(schema.ddl("Package") + ", modified timestamp, batch int").parquet(table)
    newest = rows.groupBy("package_path").agg(F.max(F.struct("batch", "modified")).alias("n")).select("package_path", "n.batch", "n.modified")
    return rows.join(newest, ["package_path", "batch", "modified"], "left_semi").drop("batch", "modified")
