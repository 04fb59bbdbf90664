"""An extraction from end to end: program tables in, fact tables out."""

from __future__ import annotations

import warnings
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, ident, paths
from ..operators import dispatch, flow, satisfaction
from ..options import Options, UsageError
from ..sources import program
from . import contracts, fixpoint
from .storage import written


def call_edges(tables: dict[str, DataFrame], options: Options) -> DataFrame:
    """(fn, block, ord, callee): the call graph that was given, or the class hierarchy's answer; none with dispatch off.

    Type flow is not computed here: 'vta' without a call graph warns and takes the class hierarchy, which names more targets.
    """
    given = tables["cg_edge"].select(F.col("caller").alias("fn"), "block", "ord", "callee")
    if options.dispatch in ("", "off"):
        return given.limit(0)
    if options.dispatch == "vta" and not given.isEmpty():
        return given
    if options.dispatch == "vta":
        warnings.warn("dispatch 'vta' without a call graph (cg_edge): targets are those of the class hierarchy", stacklevel=2)
    pairs = satisfaction.satisfies(tables["method"], tables["iface_method"])
    calls = tables["call"].where("is_invoke").select("fn", "block", "ord", F.col("iface_type").alias("iface_key"), F.col("method").alias("name"))
    # an interface says which method a name is: unexported ones of other packages are others
    calls = calls.join(tables["iface_method"].select("iface_key", "name", "method_id").distinct(), ["iface_key", "name"])
    return satisfaction.class_hierarchy(calls, pairs, tables["method"].select("type_key", "method_id", "decl_fn")).select("fn", "block", "ord", F.col("decl_fn").alias("callee"))


#: Options that no step of an extraction reads; those with a default of True are named in README.
UNREAD = (
    "base", "head", "verbose", "snapshot_store", "library_writeback", "heap_slots", "heap_slots_scope", "heap_iface_narrow", "heap_iface_identity", "heap_iface_drop", "error_results",
    "error_results_strict", "canonical_instance_ids", "surface_reads", "topic_cells", "http_seed_request", "dep_impls", "dep_bodies", "dependency_sums",
)


def reject_unread(options: Options) -> None:
    """Raises if an option asks for what an extraction doesn't do."""
    asked = [f.name for f in fields(Options) if f.name in UNREAD and getattr(options, f.name) != f.default] + (["mode"] if options.mode != "main" else [])
    if asked:
        raise UsageError(f"build does not do anything with {', '.join(asked)}")


def extract(spark: SparkSession, folder: str, options: Options = Options()) -> dict[str, DataFrame]:
    """Tables function, callsite, vertex, edge, contract and http_call of the program in ``folder``."""
    reject_unread(options)
    tables = program.read(spark, folder)
    program.toolchain_guard(tables["pkg_error"])
    mocks = program.mock_packages(tables["pkg"], tables["src_file"], classify.segments(options.mock_paths))
    packages = tables["pkg"] if options.include_mocks else tables["pkg"].join(mocks, "pkg_path", "left_anti")
    requested = [r for r in options.scope.split(",") if r]
    program.guard(packages, requested, mocks, options.allow_missing_scope)
    excluded = tables["src_file"].where("is_test").select("file")
    if not options.include_mocks:
        excluded = excluded.unionByName(program.mock_files(tables["src_file"]))
    fns = written(program.emittable(tables["func"], packages, excluded))

    edges = call_edges(tables, options)
    usable = edges.join(fns.select(F.col("fn").alias("callee")), "callee", "left_semi")
    targets = dispatch.targets_at(usable, ["fn", "block", "ord"], "callee", options.cap)
    own = lambda t: tables[t].join(fns.select("fn"), "fn", "left_semi")
    sites = written(flow.call_sites(own("call"), tables["func"], targets, tables["type"], options))
    # closures are made after all calls of a function, so these keep their numbers
    makes = own("instr").where("op = 'MakeClosure'").select("fn", "block", "ord", F.col("aux").alias("callee"))
    bound = own("operand").join(makes, ["fn", "block", "ord"], "left_semi").select("fn", "block", "ord", F.col("pos").alias("idx"), "value", F.lit(None).cast("string").alias("type"))
    n_params = tables["param"].groupBy("fn").agg(F.count("*").cast("int").alias("n"))
    closures, captured = flow.closure_sites(makes, bound, n_params, sites.groupBy("fn").agg(F.count("*").alias("n")), options)

    modules = program.module_map(packages)
    owned = fns.join(modules, "pkg_path", "left")
    functions = owned.select("fn", "pkg_path", "fqn", "signature", "file", "line", "col", ident.iid(ident.owner(F.col("module_path"), F.lit(options.repo)), F.coalesce("pkg_path", F.lit("")), F.col("fqn"), F.coalesce("signature", F.lit(""))).alias("iid"), classify.origin(F.coalesce("pkg_path", F.lit("")), F.coalesce("module_path", F.lit(""))).alias("origin"))

    # values are local to a function, so its name goes before theirs
    value = lambda c: F.concat_ws("\u0001", "fn", c)
    graph = flow.value_edges(own("instr"), own("operand"), tables["const"], options)
    labelled = graph.select(value("src").alias("src"), value("dst").alias("dst"), "op", "field", "alias", (F.col("block").cast("long") * 1_000_000 + F.col("ord")).alias("ord"))
    inputs = flow.input_vertices(own("param"), own("free_var"), options)
    outputs = flow.return_vertices(own("instr"), own("operand")).unionByName(flow.by_ref_outputs(own("param"), tables["type"], options))
    ports = flow.call_ports(sites, own("call"), own("instr"), own("operand"))
    here = inputs.unionByName(outputs).select("fn", "kind", "index", "value", "type").withColumn("callsite", F.lit(None).cast("int"))
    vertices = written(here.unionByName(ports).unionByName(captured))
    # values enter by parameters and results of calls, and leave by returns, by-ref slots and arguments of calls
    source = F.concat_ws("\u0001", "fn", "kind", F.col("index").cast("string"), F.coalesce(F.col("callsite").cast("string"), F.lit("")))
    sources = vertices.where(F.col("kind").startswith("IN_") | (F.col("kind") == "CALL_RESULT_PORT")).select(source.alias("source"), value("value").alias("node"), F.lit(0).alias("depth")).distinct()
    sinks = vertices.where(F.col("kind").startswith("OUT_") | (F.col("kind") == "CALL_ARG_PORT")).select(value("value").alias("node"), "fn", F.col("kind").alias("to_kind"), F.col("index").alias("to_index"), F.col("callsite").alias("to_callsite"))
    states = fixpoint.reach_paths(labelled, sources)
    part = F.split("source", "\u0001")
    index = part[2].cast("int")
    reached = states.join(sinks, "node").select("fn", F.when(part[1].startswith("IN_"), index).alias("from_param"), part[1].alias("from_kind"), index.alias("from_index"), F.when(part[3] != "", part[3].cast("int")).alias("from_callsite"), "to_kind", "to_index", "to_callsite", "path", "via_alias").distinct()
    sites = written(sites.unionByName(closures.withColumn("targets", F.array("callee_fqn")), allowMissingColumns=True))
    return {"function": functions, "callsite": sites, "vertex": vertices, "edge": reached, **contracts.contracts(spark, tables, fns.select("fn"), options)}


def write(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.sort(df.columns[0]).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}.parquet")


def target_names(sites: DataFrame) -> DataFrame:
    """Sites as lines: function, ordinal, kind, opaque, confidence, targets."""
    return sites.select("fn", "id", F.concat_ws("\t", "fn", F.col("id").cast("string"), "kind", F.col("opaque").cast("string"), F.format_string("%.4f", F.col("dispatch_confidence")), F.array_join("targets", ",")).alias("line"))


def package_file(package: str):
    return F.concat(paths.sanitize(F.lit(package)), F.lit(".pb"))
