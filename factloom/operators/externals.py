"""Functions beyond those that are emitted: dependencies' own, what wrappers stand for, and what else can be called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify


def external_functions(functions: DataFrame, dependencies: DataFrame, excluded: DataFrame) -> DataFrame:
    """Functions (fn, pkg_path, parent_fn, synthetic, type_args, file) that a dependency declares by name: no closures, wrappers or instances."""
    named = functions.where((F.coalesce("synthetic", F.lit("")) == "") & F.col("parent_fn").isNull() & ~classify.instance_like(F.col("type_args")))
    return named.join(dependencies.select("pkg_path").distinct(), "pkg_path", "left_semi").join(excluded.select("file").distinct(), "file", "left_anti")


def declared_targets(targets: DataFrame, externals: DataFrame) -> DataFrame:
    """(fn, declared): what a call's target stands for among the external functions; targets that stand for none are left out.

    Both have fn, object, params (types without the receiver), variadic; ``targets`` also synthetic and type_args. A function that is
    not synthetic stands for itself. A wrapper stands for the method that it wraps if it takes the same parameters; a method
    expression takes its receiver as one more, so it stands for nothing.
    """
    own = targets.where(F.coalesce("synthetic", F.lit("")) == "").select("fn").join(externals.select("fn"), "fn", "left_semi").select("fn", F.col("fn").alias("declared"))
    e = externals.select(F.col("fn").alias("declared"), "object", F.col("params").alias("__params"), F.col("variadic").alias("__variadic"))
    wrapped = targets.where((F.coalesce("synthetic", F.lit("")) != "") & F.col("object").isNotNull() & ~classify.instance_like(F.col("type_args"))).join(e, "object")
    same = F.col("params").eqNullSafe(F.col("__params")) & F.col("variadic").eqNullSafe(F.col("__variadic"))
    return own.unionByName(wrapped.where(same).select("fn", "declared")).distinct()


def with_default_leaf(sites: DataFrame) -> DataFrame:
    """Sites (targets, n_external, placeholder, confidence): where a target is external the placeholder follows the targets, as other code may run
    there too, and the confidence is one part of them all."""
    outside = F.col("n_external") > 0
    targets = F.when(outside, F.concat("targets", F.array("placeholder"))).otherwise(F.col("targets"))
    with_leaf = sites.withColumn("stored_targets", F.col("targets")).withColumn("targets", targets)
    return with_leaf.withColumn("confidence", F.when(outside, F.lit(1.0) / F.size("targets")).otherwise(F.col("confidence")))


def nested(functions: DataFrame, roots: DataFrame) -> DataFrame:
    """(fn): the roots and all functions nested in them, by ``functions`` (fn, parent_fn)."""
    from ..plans.fixpoint import semi_naive

    inside = functions.where("parent_fn IS NOT NULL").select(F.col("fn").alias("child"), F.col("parent_fn").alias("fn"))
    return semi_naive(roots.select("fn").distinct(), lambda f: f.join(inside, "fn").select(F.col("child").alias("fn")), ["fn"])


def function_universe(before: DataFrame, members: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn): what was known before dependencies were built, with their members, the methods of their named types and what is nested in these."""
    added = members.select("fn").unionByName(methods.where("decl_fn IS NOT NULL").select(F.col("decl_fn").alias("fn"))).distinct()
    return before.select("fn").unionByName(nested(functions, added)).distinct()


def with_declared_methods(collected: DataFrame, types: DataFrame, methods: DataFrame, emittable: DataFrame) -> DataFrame:
    """(fn): the collected functions, with the declared methods of the types in scope that are neither aliases nor generic."""
    named = types.where(F.col("alias_of").isNull() & (F.coalesce("n_type_params", F.lit(0)) == 0)).select("type_key")
    more = methods.where("decl_fn IS NOT NULL").join(named, "type_key", "left_semi").select(F.col("decl_fn").alias("fn")).join(emittable.select("fn"), "fn", "left_semi")
    return collected.select("fn").unionByName(more).distinct()
