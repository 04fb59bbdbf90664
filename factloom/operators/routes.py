"""HTTP routes, client calls, topics and generated contracts, from matched calls and evaluated strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, ident, paths


def routes(registrations: DataFrame, prefixes: DataFrame, mounted: DataFrame, overflowed: DataFrame) -> DataFrame:
    """Routes of registrations (reg, node, framework, pattern, pattern_method, methods array, handler, default_mux).

    Prefixes come from the receiver's facts (node, obj, prefix) and where their objects are mounted (obj, route, stripped). A
    receiver without facts, or with more than are kept, also has an unknown prefix, which is dropped from the path and leaves a
    suffix. A pattern that is a hole and nothing else names no route.
    """
    method = paths.pattern_method(F.col("pattern"))
    regs = registrations.where(F.col("handler").isNotNull())
    regs = regs.withColumn("methods", F.when(F.col("pattern_method") & (method != ""), F.array(F.upper(method))).otherwise(F.col("methods"))).withColumn("pattern", F.when(F.col("pattern_method"), paths.subtree(paths.pattern_path(F.col("pattern")))).otherwise(F.col("pattern")))
    regs = regs.where((F.col("pattern") == "") | (F.replace(F.col("pattern"), F.lit("{}"), F.lit("")) != ""))
    known = regs.join(prefixes.select("node", "obj", "prefix"), "node").join(mounted.select("obj", "route"), "obj", "left")
    known = known.withColumn("full_prefix", paths.join_path(F.coalesce("route", F.lit("")), F.col("prefix"), False))
    known = known.select(*regs.columns, "full_prefix")
    facts = prefixes.select("node").distinct().withColumn("__has", F.lit(True))
    over = overflowed.select("node").distinct().withColumn("__over", F.lit(True))
    flagged = regs.join(facts, "node", "left").join(over, "node", "left")
    top = flagged.where(F.col("default_mux") & F.col("__has").isNull()).select(*regs.columns, F.lit("").alias("full_prefix"))
    unknown = flagged.where((F.col("__has").isNull() & ~F.col("default_mux")) | F.col("__over").isNotNull()).select(*regs.columns, F.lit("{}").alias("full_prefix"))
    all_ = known.unionByName(top).unionByName(unknown)
    full = paths.join_path(F.col("full_prefix"), F.col("pattern"), F.col("framework") == "gin")
    template = F.when(full.startswith("{}"), F.substring(full, 3, 1 << 20)).otherwise(full)
    named = all_.withColumn("template", template).withColumn("path", paths.canon_path(F.col("template"))).withColumn("method", F.explode("methods"))
    named = named.withColumn("name", paths.contract_name(F.col("method"), F.col("path"))).withColumn("display", paths.display(F.col("template")))
    first = Window.partitionBy("name", "handler").orderBy("reg", "full_prefix")
    one = named.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return one.select("name", ident.contract_iid(F.col("name"), "http").alias("iid"), "method", "path", "display", "framework", "handler", (F.col("full_prefix").startswith("{}")).alias("suffix_only"))


def handler_argument(registrations: DataFrame) -> DataFrame:
    """Registrations (args array, elements array or null, handler_arg, last_handler) with ``handler``: that argument, or of several handlers,
    which stand in a slice literal, the last. No literal, no handler."""
    there = (F.col("handler_arg") >= 0) & (F.col("handler_arg") < F.size("args"))
    last = F.when(F.size(F.coalesce("elements", F.array().cast("array<string>"))) > 0, F.element_at("elements", -1))
    return registrations.withColumn("handler", F.when(there, F.when(F.col("last_handler"), last).otherwise(F.get("args", F.col("handler_arg")))))


def route_methods(registrations: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Registrations with ``methods``: the rule's own, a constant argument's, those of a list of constants, or of the calls it is chained with.

    ``registrations`` has reg, method, route_chain, n_args, method_arg and method_text (its constant, null if none), methods_arg and
    methods_texts (the elements' constants, null if the argument is no literal). What is not constant serves any method.
    """
    any_ = F.array(F.lit("*"))
    texts = F.col("methods_texts")
    all_known = texts.isNotNull() & (F.size(texts) > 0) & ~F.exists(texts, lambda x: x.isNull())
    given = lambda arg: (F.col(arg) >= 0) & (F.col(arg) < F.col("n_args"))
    found = chains if chains is not None else registrations.select("reg", F.array().cast("array<string>").alias("chained")).limit(0)
    r = registrations.join(found.select("reg", "chained"), "reg", "left")
    methods = (
        F.when((F.col("method") != "") & (F.col("method") != "*") & ~F.col("route_chain"), F.array("method"))
        .when(given("method_arg"), F.when(F.coalesce("method_text", F.lit("")) != "", F.array(F.upper("method_text"))).otherwise(any_))
        .when(given("methods_arg"), F.when(all_known, F.transform(texts, F.upper)).otherwise(any_))
        .when(F.col("route_chain") & (F.size(F.coalesce("chained", F.array().cast("array<string>"))) > 0), F.col("chained"))
        .otherwise(any_)
    )
    return r.withColumn("methods", methods).drop("chained")


def chained_methods(registrations: DataFrame, calls: DataFrame, depth: int = 8) -> DataFrame:
    """(reg, chained): methods of the calls before and after a registration in its chain, at most ``depth`` steps each way.

    ``registrations`` has reg, value (its result) and recv; ``calls`` value, recv, framework's own ``links`` (whether the chain goes on through
    it) and ``texts`` (constant methods, null if none).
    """
    from ..plans.storage import written

    c = written(calls.select(F.col("value").alias("__v"), F.col("recv").alias("__r"), "links", F.coalesce("texts", F.array().cast("array<string>")).alias("texts")))
    found = []
    for at, seen, on in (("value", "__r", "__v"), ("recv", "__v", "__r")):
        front = registrations.select("reg", F.col(at).alias("at"))
        for _ in range(depth):
            # a step is written, so the next one's plan holds no more than it
            hit = written(front.where("at IS NOT NULL").join(c, F.col("at") == F.col(seen)).select("reg", "texts", "links", F.col(on).alias("at")))
            if hit.isEmpty():
                break
            found.append(hit.select("reg", "texts"))
            front = hit.where("links").select("reg", "at")
    all_ = registrations.select("reg", F.array().cast("array<string>").alias("texts"))
    for more in found:
        all_ = all_.unionByName(more)
    return all_.select("reg", F.explode("texts").alias("m")).groupBy("reg").agg(F.array_sort(F.collect_set(F.upper("m"))).alias("chained"))


def ordered_routes(found: DataFrame) -> DataFrame:
    return found.orderBy("iid", "handler")


def ordered_fields(found: DataFrame) -> DataFrame:
    return found.orderBy("type_field", "resolver")


def resolver_calls(dispatchers: DataFrame, invokes: DataFrame, args: DataFrame) -> DataFrame:
    """(dispatcher, method, args): the first invoke on the resolver interface in a dispatcher or, if it has none, in the functions nested in it.

    ``dispatchers`` has dispatcher, fn and level (its place in a walk of the nested functions, 0 for its own body); ``invokes`` fn, block, ord,
    method; ``args`` fn, block, ord, idx and the constant key that the argument was looked up by.
    """
    first = F.min(F.struct("level", "block", "ord", "fn", "method")).alias("x")
    one = dispatchers.join(invokes, "fn").groupBy("dispatcher").agg(first).select("dispatcher", "x.fn", "x.block", "x.ord", "x.method")
    named = args.groupBy("fn", "block", "ord").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("param_idx"), F.col("key").alias("name")))).alias("args"))
    empty = F.array().cast("array<struct<param_idx:int,name:string>>")
    return one.join(named, ["fn", "block", "ord"], "left").select("dispatcher", "method", F.coalesce("args", empty).alias("args"))


def client_sites(calls: DataFrame) -> DataFrame:
    """HTTP client sites of calls (site, url template, method or ''): canonical path and the synthetic callee's name."""
    path = paths.canon_path(paths.client_path(F.col("url")))
    c = calls.withColumn("path", path).withColumn("dynamic_base", F.col("url").startswith("{}")).withColumn("resolved", paths.has_literal_segment(path))
    shown = F.when(F.col("method") == "", "*").otherwise(F.col("method"))
    return c.withColumn("callee_fqn", F.concat(F.lit("http:"), shown, F.lit(" "), "path"))


def client_census(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("sites"), F.count_if("resolved").alias("resolved_path"), F.count_if("dynamic_base").alias("dynamic_base"), F.count_if(F.col("method") == "").alias("unknown_method"))


def topics(calls: DataFrame) -> DataFrame:
    """The topic of each call from its handle's and its message's (symbols or null): the handle's if it decides, else the message's."""
    topic = F.when(F.col("handle_decides") & F.col("handle_topic").isNotNull(), F.col("handle_topic")).otherwise(F.coalesce("message_topic", "handle_topic"))
    return calls.withColumn("topic", topic).withColumn("sym", F.when(F.col("topic").isNotNull(), ident.contract_iid(paths.topic_name(F.col("topic")), "kafka")))


def callbacks(bindings: DataFrame, methods: DataFrame, name: str) -> DataFrame:
    """Push consumers: bindings (handler_type, topics) -> fn with its topics, through the handler's callback method."""
    m = methods.where(F.col("name") == name).select(F.col("type_key").alias("handler_type"), F.col("decl_fn").alias("fn"))
    return bindings.join(m, "handler_type").groupBy("fn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))


def grpc_methods(embeds: DataFrame, methods: DataFrame, generated: DataFrame) -> DataFrame:
    """RPCs of types that embed a generated server: embeds (type_key, embedded, pb_pkg, pb_name), methods (type_key, name, decl_fn, kind),
    generated (pb_pkg, service, name). A service without generated methods falls back on the handlers' shape. The least handler wins."""
    e = embeds.withColumn("service", classify.server_embed(F.col("embedded"))).where("service != ''")
    m = e.join(methods, "type_key").where("kind != 'none'")
    has = generated.select("pb_pkg", "service").distinct().withColumn("__gen", F.lit(True))
    g = generated.select("pb_pkg", "service", "name").distinct().withColumn("__hit", F.lit(True))
    ok = m.join(has, ["pb_pkg", "service"], "left").join(g, ["pb_pkg", "service", "name"], "left").where(F.col("__gen").isNull() | F.col("__hit").isNotNull())
    full = paths.grpc_name(F.col("pb_name"), F.col("service"), F.col("name"))
    one = ok.withColumn("full_name", full).withColumn("__r", F.row_number().over(Window.partitionBy("full_name").orderBy("decl_fn"))).where("__r = 1")
    return one.select("full_name", ident.contract_iid(F.col("full_name"), "grpc").alias("iid"), F.col("decl_fn").alias("handler"), F.col("kind").isin("client", "bidi").alias("client_streaming"), F.col("kind").isin("server", "bidi").alias("server_streaming"))


def narrowed_clients(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Calls on interfaces that exactly one generated client satisfies: sites (site, iface_key, method), pairs (type_key, iface_key, contract)."""
    from .satisfaction import unique_or_refuse

    hit = sites.join(pairs, "iface_key").select("site", "contract")
    return unique_or_refuse(hit, ["site"], "contract", sites)


def graphql_gate(types: DataFrame) -> DataFrame:
    """Packages with a resolver root interface and both of its companion structs."""
    has = lambda name, kind: F.count_if((F.col("name") == name) & (F.col("kind") == kind)) > 0
    g = types.groupBy("pkg_path").agg((has("ResolverRoot", "interface") & has("DirectiveRoot", "struct") & has("ComplexityRoot", "struct")).alias("ok"))
    return g.where("ok").select("pkg_path")


def graphql_fields(resolvers: DataFrame, dispatchers: DataFrame) -> DataFrame:
    """Resolver methods (type_name, method, params, decl_fn) with the field name that a generated dispatcher gives, else the method's
    with a small first letter; dispatchers (type_name, method, field)."""
    d = dispatchers.groupBy("type_name", "method").agg(F.min("field").alias("field"))
    j = resolvers.join(d, ["type_name", "method"], "left")
    field = F.coalesce("field", paths.lcfirst(F.col("method")))
    j = j.withColumn("type_field", F.concat("type_name", F.lit("."), field))
    return j.select("type_field", ident.contract_iid(paths.graphql_name(F.col("type_name"), field), "graphql").alias("iid"), F.col("decl_fn").alias("resolver"), classify.resolver_args(F.col("params"), F.col("type_name")).alias("arg_params"))


def resolve_handlers(values: DataFrame, functions: DataFrame, depth: int = 6) -> DataFrame:
    """Handler values followed to one function each, at most ``depth`` steps: values (value, op, arg), functions (value, fn).

    Ops closure, bound, convert, middleware, factory and phi lead on to ``arg``; a value that leads to several functions has none.
    """
    from ..plans.storage import written

    now = values.where("arg IS NOT NULL").select("value", "arg").distinct()
    found = front = written(functions.select("value", "fn").distinct())
    for _ in range(depth):
        front = written(now.join(front.select(F.col("value").alias("arg"), "fn"), "arg").select("value", "fn").distinct())
        if front.isEmpty():
            break
        found = found.unionByName(front)
    one = found.groupBy("value").agg(F.min("fn").alias("lo"), F.max("fn").alias("hi"))
    return one.where("lo = hi").select("value", F.col("lo").alias("fn"))


def zero_boundary(counts: dict[str, int], required: bool) -> str:
    """A message if nothing was found at any boundary; raises if something was required."""
    from ..options import NoContracts

    if sum(counts.values()):
        return ""
    text = "no boundary found: " + ", ".join(f"{k}=0" for k in sorted(counts))
    if required:
        raise NoContracts(text)
    return text
