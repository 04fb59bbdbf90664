"""Counts over facts: totals, histograms and censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(sites: DataFrame, shard: str, function: str, opaque: str) -> DataFrame:
    return sites.agg(F.countDistinct(shard).alias("shards"), F.countDistinct(function).alias("functions"), F.count("*").alias("sites"), F.count_if(F.col(opaque)).alias("opaque"))


def fanout_histogram(sites: DataFrame, callees: str) -> DataFrame:
    return sites.groupBy(F.size(callees).alias("fanout")).agg(F.count("*").alias("sites"))


def confidence_histogram(sites: DataFrame, confidence: str) -> DataFrame:
    return sites.groupBy(F.format_string("%.4f", F.col(confidence)).alias("confidence")).agg(F.count("*").alias("sites"))


def site_census(sites: DataFrame, **tests: Column) -> DataFrame:
    """The number of sites, and of those that pass each test."""
    return sites.agg(F.count("*").alias("sites"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def topic_census(uses: DataFrame, side: str = "side", topic: str = "topic", cause: str = "cause") -> DataFrame:
    """Per side: uses with a topic, and without one by cause; distinct topics."""
    none = F.col(topic).isNull()
    return uses.groupBy(side).agg(
        F.count("*").alias("uses"), F.count_if(~none).alias("resolved"), F.count_if(none & (F.col(cause) == "param")).alias("from_param"), F.count_if(none & (F.col(cause) == "field")).alias("from_config"),
        F.count_if(none & ~F.coalesce(F.col(cause), F.lit("other")).isin("param", "field")).alias("other"), F.countDistinct(topic).alias("cells"),
    )


def route_census(routes: DataFrame, framework: str = "framework") -> DataFrame:
    """Total and ``framework=n`` in order of the name."""
    per = routes.groupBy(framework).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("routes"), F.array_join(F.array_sort(F.collect_list(F.concat(F.col(framework), F.lit("="), F.col("n").cast("string")))), " ").alias("by_framework"))


def most_frequent(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
