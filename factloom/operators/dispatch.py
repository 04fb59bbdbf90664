"""Dispatch: which functions a call site can reach, from the edges of a call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Targets of a site beyond which none is named.
CAP = 10


def confidence(n: Column, cap: int = CAP) -> Column:
    """1 for no or one target, 1/n up to the cap, 1 beyond it, where no target is named."""
    return F.when((n >= 2) & (n <= cap), F.lit(1.0) / n).otherwise(F.lit(1.0))


def targets_at(edges: DataFrame, site: list[str], target: str, cap: int = CAP) -> DataFrame:
    """Per site: targets (sorted, none if capped), n_targets (cap + 1 stands for more), capped, opaque, confidence.

    At most cap + 1 distinct targets of a site leave a task, so a site with very many is no larger than others.
    """
    by = Window.partitionBy(*site).orderBy(target)
    first = edges.select(*site, target).where(F.col(target).isNotNull()).distinct().withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= cap + 1)
    found = first.groupBy(*site).agg(F.sort_array(F.collect_list(target)).alias("targets"), F.count("*").cast("int").alias("n_targets"))
    capped = F.col("n_targets") > cap
    return found.select(*site, F.when(capped, F.slice("targets", 1, 0)).otherwise(F.col("targets")).alias("targets"), "n_targets", capped.alias("capped"), capped.alias("opaque"), confidence(F.col("n_targets"), cap).alias("confidence"))


def with_externals(own: DataFrame, external: DataFrame, site: list[str], cap: int = CAP) -> DataFrame:
    """Adds a site's external targets if all fit under the cap; otherwise its own stay alone."""
    both = own.join(external.select(*site, F.col("targets").alias("__ext")), site, "full")
    own_t = F.coalesce("targets", F.expr("array()").cast("array<string>"))
    merged = F.array_union(own_t, F.coalesce("__ext", F.expr("array()").cast("array<string>")))
    return both.select(*site, F.when(F.size(merged) <= cap, F.array_sort(merged)).otherwise(own_t).alias("targets"))


def dropped_generics(edges: DataFrame, site: list[str], generic: str, kept: str) -> DataFrame:
    """Edges to generic instances that dispatch lost: edges, sites that lost all, sites that lost some."""
    per = edges.groupBy(*site).agg(F.count_if(F.col(generic) & ~F.col(kept)).alias("lost"), F.count_if(F.col(kept)).alias("kept"))
    return per.agg(F.sum("lost").alias("edges"), F.count_if((F.col("lost") > 0) & (F.col("kept") == 0)).alias("sites_all_lost"), F.count_if((F.col("lost") > 0) & (F.col("kept") > 0)).alias("sites_some_lost"))


def resolve_callees(sites: DataFrame) -> DataFrame:
    """The callees of a site in order of precedence.

    ``sites`` has remote, static_emitted, static_owner (identities or null), dispatch (array) and placeholder. A remote
    contract wins, then the static callee (emitted here, or by its owner), then the dispatch targets, then the name alone.
    """
    static = F.coalesce("static_emitted", "static_owner")
    callees = F.when(F.col("remote").isNotNull(), F.array("remote")).when(static.isNotNull(), F.array(static)).when(F.size(F.coalesce("dispatch", F.array())) > 0, F.col("dispatch")).otherwise(F.array("placeholder"))
    how = F.when(F.col("remote").isNotNull(), "remote").when(F.col("static_emitted").isNotNull(), "static").when(F.col("static_owner").isNotNull(), "external").when(F.size(F.coalesce("dispatch", F.array())) > 0, "dispatch").otherwise("name")
    return sites.withColumn("callees", callees).withColumn("resolved_by", how)


def ordinals(instructions: DataFrame, function: str, *order: Column) -> DataFrame:
    """Numbers the calls of each function from 0 in a total order."""
    return instructions.withColumn("ordinal", F.row_number().over(Window.partitionBy(function).orderBy(*order)) - 1)
