"""Which types satisfy which interfaces, and what follows from it.

Satisfaction is relational division: a type satisfies an interface if it has all of its methods with equal signatures. A pair
is only formed where the type has the interface's rarest method, which keeps common methods from multiplying rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ident import entries_digest

KEY = ("method_id", "sig")


def satisfies(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """methods (type_key, method_id, sig, in_value_set) x interfaces (iface_key, method_id, sig) -> type_key, iface_key, pointer_only.

    Interfaces without methods yield no pairs.
    """
    m = methods.groupBy("type_key", *KEY).agg(F.max("in_value_set").alias("in_value_set"))
    need = interfaces.select("iface_key", *KEY).distinct()
    spread = m.groupBy(*KEY).agg(F.count("*").alias("types"))
    rare = Window.partitionBy("iface_key").orderBy(F.coalesce("types", F.lit(0)), *KEY)
    size = need.groupBy("iface_key").agg(F.count("*").alias("needs"))
    anchor = need.join(spread, list(KEY), "left").withColumn("r", F.row_number().over(rare)).where("r = 1 AND types IS NOT NULL").select("iface_key", *KEY)
    pairs = anchor.join(m.select("type_key", *KEY), list(KEY)).select("type_key", "iface_key")
    have = pairs.join(need, "iface_key").join(m, ["type_key", *KEY]).groupBy("type_key", "iface_key").agg(F.count("*").alias("has"), F.count_if("in_value_set").alias("by_value"))
    return have.join(size, "iface_key").where("has = needs").select("type_key", "iface_key", (F.col("by_value") < F.col("needs")).alias("pointer_only"))


def class_hierarchy(calls: DataFrame, pairs: DataFrame, methods: DataFrame) -> DataFrame:
    """Invoke sites (with iface_key and method_id) -> one row per possible callee (decl_fn)."""
    return calls.join(pairs.select("type_key", "iface_key"), "iface_key").join(methods.select("type_key", "method_id", "decl_fn"), ["type_key", "method_id"])


def declared_implementations(sites: DataFrame, pairs: DataFrame, methods: DataFrame, cap: int = 10) -> DataFrame:
    """Targets of unresolved invoke sites from dependency types, where there are 1 to ``cap`` of them."""
    keys = [c for c in sites.columns]
    hit = class_hierarchy(sites, pairs, methods).select(*keys, "decl_fn").distinct()
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("decl_fn"))).where(F.col("r") <= cap + 1)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("decl_fn")).alias("targets")).where(F.size("targets") <= cap)


def unique_or_refuse(matches: DataFrame, key: list[str], value: str, all_keys: DataFrame | None = None) -> DataFrame:
    """One distinct value -> it; none -> unclassified; several -> ambiguous."""
    low, high = F.min(value).alias("low"), F.max(value).alias("high")
    found = matches.groupBy(*key).agg(low, high)
    if all_keys is not None:
        found = all_keys.select(*key).distinct().join(found, key, "left")
    one = F.col("low") == F.col("high")
    return found.select(*key, F.when(one, F.col("low")).alias("value"), F.when(F.col("low").isNull(), "unclassified").when(one, "unique").otherwise("ambiguous").alias("outcome"))


def method_fingerprints(methods: DataFrame) -> DataFrame:
    """type_key -> digest over its pointer method set in order of id, with whether each is in the value set."""
    entry = F.struct(F.col("method_id").alias("id"), "sig", F.when(F.col("in_value_set"), "pv").otherwise("p").alias("set"))
    return methods.groupBy("type_key").agg(entries_digest(F.sort_array(F.collect_list(entry)), ("id", "sig", "set")).alias("msfp"))


def interface_fingerprints(interfaces: DataFrame) -> DataFrame:
    entry = F.struct(F.col("method_id").alias("id"), "sig")
    return interfaces.groupBy("iface_key").agg(entries_digest(F.sort_array(F.collect_list(entry)), ("id", "sig")).alias("ifp"))
