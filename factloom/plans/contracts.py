"""What a program serves and calls: gRPC methods, HTTP routes and HTTP client calls, from the tables of the program.

Values are named by their function and themselves, constants by themselves alone, as a program's constants are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify
from ..functions import strings as S
from ..operators import flow, links, routes, signatures
from ..options import Options
from . import fixpoint
from .storage import written

KEYS = ["fn", "block", "ord"]
_COPIES = ("Convert", "ChangeType", "ChangeInterface", "MakeInterface", "UnOp")


def local(value: str = "value", fn: str = "fn") -> Column:
    return F.concat_ws("\u0001", fn, value)


def called(tables: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """Calls of the functions ``own`` (fn): keys, value (result), recv, args, and pkg, recv_name and name of what is called."""
    calls = tables["call"].join(own.select("fn"), "fn", "left_semi")
    callee = tables["func"].select(F.col("fn").alias("static_callee"), F.col("pkg_path").alias("__pkg"), F.coalesce("recv_type", F.lit("")).alias("__recv"), F.element_at(F.split("fqn", r"\."), -1).alias("__name"))
    iface = tables["type"].select(F.col("type_key").alias("iface_type"), F.col("pkg_path").alias("__ipkg"), F.col("name").alias("__iname"))
    c = calls.join(callee, "static_callee", "left").join(iface, "iface_type", "left")
    bare = F.regexp_replace(F.col("__recv"), r"^.*[./*]", "")
    named = F.concat(F.lit("\u0001"), "value")
    consts = tables["const"].select("value", F.lit(True).alias("__const")).distinct()
    ops = tables["operand"].join(consts, "value", "left").withColumn("v", F.when(F.col("__const"), named).otherwise(local()))
    ops = ops.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("ops"))
    made = tables["instr"].select(*KEYS, local().alias("result"))
    c = c.join(ops, KEYS, "left").join(made, KEYS, "left").withColumn("ops", F.coalesce("ops", F.array().cast("array<string>")))
    # operand 0 is what is called, of an invoke the receiver; a method's receiver is its first argument
    has_recv = F.col("__recv").isNotNull() & (F.col("__recv") != "")
    skip = F.when(F.col("is_invoke"), 1).when(has_recv, 2).otherwise(1)
    return c.select(
        *KEYS, F.col("result").alias("value"), F.when(F.col("is_invoke"), F.get("ops", F.lit(0))).when(has_recv, F.get("ops", F.lit(1))).alias("recv"), F.slice("ops", skip + 1, F.size("ops") + 1).alias("args"),
        F.when(F.col("is_invoke"), F.col("__ipkg")).otherwise(F.col("__pkg")).alias("pkg"), F.when(F.col("is_invoke"), F.col("__iname")).otherwise(F.coalesce(bare, F.lit(""))).alias("recv_name"), F.when(F.col("is_invoke"), F.col("method")).otherwise(F.col("__name")).alias("name"),
    )


def texts(tables: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """(value, str): the abstract strings of constants and of what is made of them."""
    none = F.array().cast("array<string>")
    consts = tables["const"].where("kind = 'string'").select(F.concat(F.lit("\u0001"), "value").alias("value"), F.lit("const").alias("op"), F.col("literal").alias("text"), none.alias("args")).distinct()
    known = tables["const"].select("value", F.lit(True).alias("__const")).distinct()
    ops = tables["operand"].join(own.select("fn"), "fn", "left_semi").join(known, "value", "left").withColumn("v", F.when(F.col("__const"), F.concat(F.lit("\u0001"), "value")).otherwise(local()))
    ops = ops.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("args"))
    instr = tables["instr"].where("value IS NOT NULL").join(ops, KEYS, "left")
    op = F.when((F.col("op") == "BinOp") & (F.col("aux") == "+"), "concat").when(F.col("op") == "Phi", "same").when(F.col("op").isin(*_COPIES), "copy").otherwise("other")
    made = instr.join(own.select("fn"), "fn", "left_semi").select(local().alias("value"), op.alias("op"), F.lit(None).cast("string").alias("text"), F.when(op == "other", none).otherwise(F.coalesce("args", none)).alias("args"))
    params = tables["param"].join(own.select("fn"), "fn", "left_semi").select(local().alias("value"), F.lit("param").alias("op"), F.lit(None).cast("string").alias("text"), none.alias("args"))
    return fixpoint.evaluate_strings(consts.unionByName(made).unionByName(params).dropDuplicates(["value"]))


def handlers(tables: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """(value, target): functions that values stand for, through closures, conversions and functions' names."""
    fns = tables["func"].select("fn")
    made = tables["instr"].join(own.select("fn"), "fn", "left_semi").where("value IS NOT NULL")
    closures = made.where("op = 'MakeClosure'").select(local().alias("value"), F.col("aux").alias("fn"))
    # an operand that is a function's name stands for that function
    named = tables["operand"].join(own.select("fn"), "fn", "left_semi").join(fns.select(F.col("fn").alias("value"), F.col("fn").alias("target")), "value").select(local().alias("value"), F.col("target").alias("fn"))
    steps = made.where(F.col("op").isin(*_COPIES, "Phi")).join(tables["operand"].select(*KEYS, F.col("value").alias("arg")), KEYS).select(local().alias("value"), F.lit("convert").alias("op"), local("arg").alias("arg"))
    return routes.resolve_handlers(steps, closures.unionByName(named)).select("value", F.col("fn").alias("target"))


def http_routes(spark: SparkSession, tables: dict[str, DataFrame], own: DataFrame, calls: DataFrame, strings: DataFrame) -> DataFrame:
    """Routes of all registrations: name, iid, method, path, display, framework, handler, suffix_only."""
    matched = written(links.first_rule(calls.withColumnRenamed("recv_name", "rule_recv"), rules.router_rules(spark).withColumnRenamed("recv", "rule_recv"), ["pkg", "rule_recv", "name"], KEYS))
    text = strings.select("value", S.template(F.col("str")).alias("template"), S.known(F.col("str")).alias("constant"))
    arg = lambda c: F.when(F.col(c) >= 0, F.get("args", F.col(c)))
    if matched.where("op = 'route'").isEmpty():
        # no registration, so no need for prefixes and mounts
        return spark.createDataFrame([], "name string, iid binary, method string, path string, display string, framework string, handler string, suffix_only boolean")
    with_path = written(matched.withColumn("__p", arg("path_arg")).join(text.select(F.col("value").alias("__p"), F.col("template").alias("path_text")), "__p", "left"))
    to = written(handlers(tables, own))
    copies = flow.value_edges(tables["instr"].join(own.select("fn"), "fn", "left_semi"), tables["operand"].join(own.select("fn"), "fn", "left_semi"), tables["const"]).where("op = 'plain' AND NOT alias")
    edge = lambda df, src, dst, append: df.select(src.alias("src"), dst.alias("dst"), append.alias("append"), F.lit(False).alias("slash"))
    none = F.lit(None).cast("string")
    steps = with_path.where("op IN ('group', 'same') AND value IS NOT NULL AND recv IS NOT NULL")
    edges = edge(steps, F.col("recv"), F.col("value"), F.when(F.col("op") == "group", F.coalesce("path_text", F.lit("{}")))).unionByName(edge(copies, local("src"), local("dst"), none))
    # a sub-router is the first parameter of the function that it is given to
    first = tables["param"].where("idx = 0").select(F.col("fn").alias("target"), local().alias("__into"))
    subs = with_path.where("op = 'sub'").withColumn("__f", arg("fn_arg")).join(to.select(F.col("value").alias("__f"), "target"), "__f").join(first, "target")
    edges = edges.unionByName(edge(subs, F.col("recv"), F.col("__into"), F.when(F.col("path_arg") >= 0, F.coalesce("path_text", F.lit("{}")))))
    seeds = matched.where("op = 'new' AND value IS NOT NULL").select(F.col("value").alias("node"), F.col("value").alias("obj"), F.lit("").alias("prefix"))
    # loops read what is written, not the plans that it comes from
    facts, overflowed = fixpoint.prefixes(written(edges), seeds)
    facts = written(facts)
    at = facts.select(F.col("node").alias("recv"), F.col("obj").alias("parent"), F.col("prefix").alias("rel"))
    below = facts.select(F.col("node").alias("__h"), F.col("obj").alias("child")).distinct()
    hung = with_path.where("op = 'mount'").withColumn("__h", arg("handler_arg")).join(below, "__h").join(at, "recv", "left")
    table = hung.select("parent", F.coalesce("rel", F.lit("")).alias("rel"), F.coalesce("path_text", F.lit("{}")).alias("prefix"), "child", F.lit(False).alias("strip"), F.col("parent").isNotNull().alias("known"))
    mounted = fixpoint.mounts(written(table)).select("obj", "route")
    # registrations
    reg = with_path.where("op = 'route'").withColumn("reg", F.concat_ws("\u0001", "fn", F.col("block").cast("string"), F.col("ord").cast("string")))
    reg = routes.handler_argument(reg.withColumn("elements", F.when(F.col("last_handler"), F.slice("args", F.col("handler_arg") + 1, F.size("args") + 1))))
    reg = reg.withColumnRenamed("handler", "__h").join(to.select(F.col("value").alias("__h"), F.col("target").alias("handler")), "__h", "left")
    named = reg.withColumn("__m", arg("method_arg")).join(text.select(F.col("value").alias("__m"), F.col("constant").alias("method_text")), "__m", "left")
    named = named.withColumn("n_args", F.size("args")).withColumn("methods_texts", F.lit(None).cast("array<string>"))
    chain = with_path.where("op IN ('group', 'same')").select("value", "recv", F.lit(True).alias("links"), F.lit(None).cast("array<string>").alias("texts"))
    listed = matched.where("methods_arg >= 0").select("value", F.posexplode(F.slice("args", F.col("methods_arg") + 1, F.size("args") + 1)).alias("at", "__a")).join(text.select(F.col("value").alias("__a"), "constant"), "__a", "left")
    lists = listed.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "constant"))), lambda x: x["constant"]).alias("__texts"))
    chain = chain.join(lists, "value", "left").withColumn("texts", F.when(~F.exists(F.coalesce("__texts", F.array().cast("array<string>")), lambda x: x.isNull()), F.col("__texts"))).drop("__texts")
    reg, named = written(reg), written(named)
    served = routes.route_methods(named, routes.chained_methods(reg.where("route_chain").select("reg", "value", "recv"), chain))
    ready = served.select("reg", F.col("recv").alias("node"), "framework", F.coalesce("path_text", F.lit("")).alias("pattern"), "pattern_method", "methods", "handler", "default_mux")
    return routes.routes(ready, facts, mounted, overflowed)


def http_calls(spark: SparkSession, calls: DataFrame, strings: DataFrame) -> DataFrame:
    """Client calls: fn, block, ord, method, path, callee_fqn, resolved, dynamic_base."""
    matched = links.first_rule(calls.withColumnRenamed("recv_name", "rule_recv"), rules.client_rules(spark).withColumnRenamed("recv", "rule_recv"), ["pkg", "rule_recv", "name"], KEYS)
    text = strings.select("value", S.template(F.col("str")).alias("template"), S.known(F.col("str")).alias("constant"))
    arg = lambda c: F.when(F.col(c) >= 0, F.get("args", F.col(c)))
    urls = matched.withColumn("__u", arg("url_arg")).join(text.select(F.col("value").alias("__u"), F.col("template").alias("url")), "__u")
    urls = urls.withColumn("__m", arg("method_arg")).join(text.select(F.col("value").alias("__m"), F.upper("constant").alias("__method")), "__m", "left")
    sites = urls.select(*KEYS, "url", F.when(F.col("method") != "", F.col("method")).otherwise(F.coalesce("__method", F.lit(""))).alias("method"))
    return routes.client_sites(sites).select(*KEYS, "method", "path", "callee_fqn", "resolved", "dynamic_base")


def grpc_methods(tables: dict[str, DataFrame], options: Options = Options()) -> DataFrame:
    """RPCs that the program's types serve: full_name, iid, handler, client_streaming, server_streaming."""
    segments = classify.segments(options.pb_paths)
    t = tables["type"].where(classify.pb_match(F.col("pkg_path"), segments))
    pb_name = F.element_at(F.split("pkg_path", "/"), -1)
    embeds = tables["field"].where("embedded").select("type_key", F.col("ftype").alias("__t")).join(t.select(F.col("type_key").alias("__t"), F.col("name").alias("embedded"), F.col("pkg_path").alias("pb_pkg"), pb_name.alias("pb_name")), "__t").drop("__t")
    service = F.regexp_extract("name", "^(.+)Server$", 1)
    generated = tables["iface_method"].select("iface_key", F.col("name").alias("__m")).join(t.where("kind = 'interface' AND name LIKE '%Server'").select(F.col("type_key").alias("iface_key"), F.col("pkg_path").alias("pb_pkg"), service.alias("service")), "iface_key").select("pb_pkg", "service", F.col("__m").alias("name"))
    types = tables["param"].groupBy(F.col("fn").alias("decl_fn")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "type"))), lambda x: x["type"]).alias("params"))
    signature = tables["func"].select(F.col("fn").alias("decl_fn"), F.regexp_extract(F.coalesce("signature", F.lit("")), r"\)\s*\(?([^()]*)\)?$", 1).alias("__results"))
    m = tables["method"].where("decl_fn IS NOT NULL").select("type_key", "name", "decl_fn").distinct().join(types, "decl_fn").join(signature, "decl_fn", "left")
    m = m.join(embeds.select("type_key", classify.server_embed(F.col("embedded")).alias("__service")).where("__service != ''").distinct(), "type_key")
    results = F.filter(F.split("__results", ", "), lambda x: x != "")
    sends = tables["iface_method"].where("name = 'Send'").join(tables["type"].select(F.col("type_key").alias("iface_key"), F.col("name").alias("__stream")), "iface_key").select("__stream", F.lit(True).alias("__sends")).distinct()
    m = m.withColumn("__stream", F.concat("__service", F.lit("_"), "name", F.lit("Server"))).join(sends, "__stream", "left")
    kinds = m.select("type_key", "name", "decl_fn", classify.handler_kind(F.col("params"), results, F.col("name"), F.col("__service"), F.coalesce("__sends", F.lit(False))).alias("kind"))
    return routes.grpc_methods(embeds, kinds, generated)


def contracts(spark: SparkSession, tables: dict[str, DataFrame], own: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """Tables contract (kind, name, iid, handler, params) and http_call of the functions ``own``."""
    calls = written(called(tables, own))
    structs = tables["type"].select("pkg_path", "name", "kind")
    rpc = grpc_methods(tables, options).join(own.select(F.col("fn").alias("handler")), "handler", "left_semi")
    messages = signatures.request_message_params(tables["param"], structs, classify.segments(options.pb_paths)).withColumnRenamed("fn", "handler")
    found = rpc.join(messages, "handler", "left").select(F.lit("GRPC").alias("kind"), F.col("full_name").alias("name"), "iid", "handler", "params")
    known = rules.router_rules(spark).select("pkg").unionByName(rules.client_rules(spark).select("pkg")).distinct()
    if not (options.http_routes or options.http_calls) or calls.join(F.broadcast(known), "pkg", "left_semi").isEmpty():
        # no call of a known library, so no string is asked for
        sent = spark.createDataFrame([], "fn string, block int, ord int, method string, path string, callee_fqn string, resolved boolean, dynamic_base boolean")
        return {"contract": written(found), "http_call": sent}
    strings = written(texts(tables, own))
    if options.http_routes:
        requests = signatures.http_request_params(tables["param"], rules.request_types(spark)).withColumnRenamed("fn", "handler")
        found = found.unionByName(http_routes(spark, tables, own, calls, strings).join(requests, "handler", "left").select(F.lit("HTTP").alias("kind"), "name", "iid", "handler", "params"))
    sent = http_calls(spark, calls, strings)
    return {"contract": written(found), "http_call": written(sent if options.http_calls else sent.limit(0))}
