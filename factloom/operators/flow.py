"""Value-flow graphs of functions, built from the tables of a program.

Every kind of instruction is one projection that yields edges (fn, src, dst, op, field, alias); the graph is their union.
Calls are barriers: their arguments and results are ports (:func:`call_ports`), which the field-sensitive reachability of
:mod:`factloom.plans.fixpoint` connects to parameters and returns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, ident
from ..options import Options

#: Steps through which a container's origin is followed.
PEEL = 8


def _edges(rows: DataFrame, src: str | Column, dst: str | Column, op: str = "plain", field: str | None = None, alias: bool = False) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("fn", col(src).alias("src"), col(dst).alias("dst"), F.lit(op).alias("op"), (F.col(field) if field else F.lit(None)).cast("int").alias("field"), F.lit(alias).alias("alias"), "block", "ord").where("src IS NOT NULL AND dst IS NOT NULL")


def operands(instr: DataFrame, operand: DataFrame) -> DataFrame:
    """Instructions with their operands; constants carry nothing and are dropped by an anti join at the caller."""
    return instr.join(operand.select("fn", "block", "ord", "pos", F.col("value").alias("arg")), ["fn", "block", "ord"])


def value_edges(instr: DataFrame, operand: DataFrame, consts: DataFrame, options: Options = Options()) -> DataFrame:
    """Edges of all instructions but calls.

    Operands by position: Store address 0, value 1; MapUpdate map 0, key 1, value 2; Send channel 0, value 1; others in order.
    """
    ins = operands(instr, operand).join(consts.select(F.col("value").alias("arg")), "arg", "left_anti")
    at = lambda op, pos: ins.where((F.col("op") == op) & (F.col("pos") == pos))
    keys = ["fn", "block", "ord"]

    def pair(op: str, src: int, dst: int) -> DataFrame:
        return at(op, src).select(*keys, F.col("arg").alias("s")).join(at(op, dst).select(*keys, F.col("arg").alias("d")), keys)

    parts = [
        # an address of a field reads that field of its base; a store through it writes the field back
        _edges(at("FieldAddr", 0), "arg", "value", "proj", "field_idx", alias=True),
        _edges(at("Field", 0), "arg", "value", "proj", "field_idx"),
        _edges(at("FieldAddr", 0), "value", "arg", "inject", "field_idx", alias=True),
        _edges(pair("Store", 1, 0), "s", "d", alias=True),
        _edges(ins.where(F.col("op").isin("UnOp", "Phi", "Convert", "ChangeType", "ChangeInterface", "MakeInterface", "TypeAssert", "Slice", "BinOp", "Index", "IndexAddr", "Lookup", "Range", "Next", "SliceToArrayPointer")), "arg", "value"),
        _edges(at("IndexAddr", 0), "value", "arg", alias=True),
    ]
    if options.container_writes:
        parts += [_edges(pair("MapUpdate", 1, 0), "s", "d"), _edges(pair("MapUpdate", 2, 0), "s", "d"), _edges(pair("Send", 1, 0), "s", "d"), _edges(pair("Select", 1, 0), "s", "d")]
    if options.field_paths is False:
        parts = [p.withColumn("op", F.lit("plain")) for p in parts]
    return reduce(DataFrame.unionByName, parts).distinct()


def peeled(edges: DataFrame, values: DataFrame, depth: int = PEEL) -> DataFrame:
    """(fn, value, origin): values followed back through copies, at most ``depth`` steps."""
    back = edges.where("op = 'plain' AND NOT alias").groupBy("fn", "dst").agg(F.min("src").alias("src"), F.count("*").alias("n")).where("n = 1").select("fn", "dst", "src")
    now = values.select("fn", "value", F.col("value").alias("origin"))
    for _ in range(depth):
        step = back.select("fn", F.col("dst").alias("origin"), F.col("src").alias("next"))
        now = now.join(step, ["fn", "origin"], "left").select("fn", "value", F.coalesce("next", "origin").alias("origin"))
    return now


def input_vertices(params: DataFrame, free: DataFrame, options: Options = Options()) -> DataFrame:
    """Parameters in order, then captured variables numbered after them."""
    n = params.groupBy("fn").agg(F.count("*").cast("int").alias("n"))
    p = params.select("fn", F.lit("IN_PARAM").alias("kind"), F.col("idx").alias("index"), "value", "type")
    if not options.closure_flow:
        return p
    f = free.join(n, "fn", "left").select("fn", F.lit("IN_PARAM").alias("kind"), (F.col("idx") + F.coalesce("n", F.lit(0))).alias("index"), "value", "type")
    return p.unionByName(f)


def by_ref_outputs(params: DataFrame, types: DataFrame, options: Options = Options()) -> DataFrame:
    """Slots through which a function writes back into what it was given."""
    if not options.byref_out:
        return params.select("fn", F.lit("OUT_PARAM_BYREF").alias("kind"), F.col("idx").alias("index"), "value", "type").limit(0)
    k = types.select(F.col("type_key").alias("type"), F.col("kind").alias("__kind"))
    return params.join(k, "type").where(classify.by_ref(F.col("__kind"), options.container_writes)).select("fn", F.lit("OUT_PARAM_BYREF").alias("kind"), F.col("idx").alias("index"), "value", "type")


def return_vertices(instr: DataFrame, operand: DataFrame) -> DataFrame:
    r = operands(instr.where("op = 'Return'"), operand)
    return r.select("fn", F.lit("OUT_RETURN").alias("kind"), F.col("pos").alias("index"), F.col("arg").alias("value"), F.lit(None).cast("string").alias("type")).distinct()


def call_ports(sites: DataFrame, calls: DataFrame, instr: DataFrame, operand: DataFrame) -> DataFrame:
    """Arguments and results of call sites: fn, kind, index, value, type, callsite.

    A call's operand 0 is what is called, which of an invoke is the receiver and its argument 0; the others are arguments in
    order. Of a result of several values, each Extract is a port of its own, by its ``field_idx``.
    """
    keys = ["fn", "block", "ord"]
    c = calls.select(*keys, "is_invoke").join(sites.select(*keys, F.col("id").alias("callsite")), keys)
    no_type = F.lit(None).cast("string").alias("type")
    index = F.when(F.col("is_invoke"), F.col("pos")).otherwise(F.col("pos") - 1)
    args = c.join(operand, keys).withColumn("index", index).where("index >= 0").select("fn", F.lit("CALL_ARG_PORT").alias("kind"), "index", "value", no_type, "callsite")
    made = c.join(instr.select(*keys, "value", "type"), keys).where("value IS NOT NULL").select("fn", "callsite", "value", "type")
    taken = operands(instr.where("op = 'Extract'"), operand).select("fn", F.col("arg").alias("value"), F.col("field_idx").alias("part"), F.col("value").alias("part_value"), F.col("type").alias("part_type"))
    results = made.join(taken, ["fn", "value"], "left").select("fn", F.lit("CALL_RESULT_PORT").alias("kind"), F.coalesce("part", F.lit(0)).alias("index"), F.coalesce("part_value", "value").alias("value"), F.when(F.col("part_value").isNull(), F.col("type")).otherwise(F.col("part_type")).alias("type"), "callsite")
    return args.unionByName(results).distinct()


def call_sites(calls: DataFrame, functions: DataFrame, targets: DataFrame, types: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Call sites in order, with kind, callee, opaqueness and confidence.

    An interface call is VIRTUAL even under go and defer. Without targets it is not opaque unless capped; a call of a function
    value without targets is. Streams and remote clients are recognised by their types' names.
    """
    numbered = emitted_calls(calls, options).withColumn("id", F.row_number().over(Window.partitionBy("fn").orderBy("block", "ord")) - 1)
    t = targets.select("fn", "block", "ord", "targets", "capped", F.col("confidence").alias("__c"))
    j = numbered.join(t, ["fn", "block", "ord"], "left").join(functions.select(F.col("fn").alias("static_callee"), F.col("fqn").alias("static_fqn"), "recv_type"), "static_callee", "left")
    segs = classify.segments(options.pb_paths)
    pkg, name = F.regexp_extract("iface_type", r"^\*?(.*)\.[^.]*$", 1), F.regexp_extract("iface_type", r"([^.]*)$", 1)
    short = F.substring_index(pkg, "/", -1)
    remote = F.when(F.col("is_invoke"), classify.grpc_client(pkg, short, name, F.col("method"), segs))
    stream = F.when(F.col("is_invoke"), classify.stream_port(pkg, short, name, F.col("method"), segs))
    none = F.coalesce(F.size("targets"), F.lit(0)) == 0
    capped = F.coalesce("capped", F.lit(False))
    kind = F.when(stream.isNotNull() | remote.isNotNull(), "INVOKES_REMOTE").when(F.col("is_invoke"), "VIRTUAL").when(F.col("kind") == "Go", "GO").when(F.col("kind") == "Defer", "DEFER").otherwise("STATIC")
    opaque = F.when(F.col("is_builtin") | F.col("static_callee").isNotNull() | (kind == "INVOKES_REMOTE"), False).when(F.col("is_invoke"), capped).otherwise(capped | none)
    fqn = F.coalesce(stream["contract"], remote, F.col("static_fqn"), F.when(F.col("is_invoke"), F.concat(F.lit("("), "iface_type", F.lit(")."), "method")), F.lit(""))
    return j.select(
        "fn", "block", "ord", "id", kind.alias("kind"), fqn.alias("callee_fqn"), F.coalesce("targets", F.expr("array()").cast("array<string>")).alias("targets"), opaque.alias("opaque"),
        F.when(kind == "VIRTUAL", F.coalesce("__c", F.lit(1.0))).otherwise(F.lit(1.0)).cast("float").alias("dispatch_confidence"),
        (F.col("is_invoke") | (F.coalesce("recv_type", F.lit("")) != "")).alias("arg0_is_receiver"), F.coalesce(stream["op"], F.lit("NONE")).alias("stream_op"), F.coalesce(stream["client_side"], F.lit(False)).alias("stream_client_side"),
    )


def emitted_calls(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """The calls that become call sites: with heap slots a copy of two arguments (func_value copy, n_args) is an edge instead, and has no number."""
    if not options.heap_slots:
        return calls
    copy = F.col("is_builtin") & (F.col("func_value") == "copy") & (F.col("n_args") == 2) & ~F.col("is_invoke")
    return calls.where(~F.coalesce(copy, F.lit(False)))


def closure_sites(closures: DataFrame, bindings: DataFrame, n_params: DataFrame, n_calls: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(sites, ports): a site for each closure made, after all calls of its function, whose arguments are the captured values.

    ``closures`` has fn, block, ord, callee; ``bindings`` fn, block, ord, idx, value, type; ``n_params`` (fn, n) counts a closure's parameters without
    a receiver, after which captured values are numbered; ``n_calls`` (fn, n) counts a function's calls. Results are delivered where the
    closure is called, so these sites have none.
    """
    keys = ["fn", "block", "ord"]
    bound = bindings.groupBy(*keys).agg(F.count("*").cast("int").alias("__n"))
    c = closures.where(F.lit(options.closure_flow)).join(bound, keys)
    c = c.join(n_params.select(F.col("fn").alias("callee"), F.col("n").alias("__base")), "callee", "left").join(n_calls.select("fn", F.col("n").alias("__calls")), "fn", "left")
    base = F.coalesce("__base", F.lit(0))
    number = F.row_number().over(Window.partitionBy("fn").orderBy("block", "ord")) - 1 + F.coalesce("__calls", F.lit(0))
    made = c.select(*keys, number.cast("int").alias("id"), F.lit("STATIC").alias("kind"), F.col("callee").alias("callee_fqn"), (base + F.col("__n")).alias("argc"), F.lit(0).alias("resultc"), F.lit(1.0).alias("dispatch_confidence"), base.alias("__base"))
    ports = made.join(bindings, keys).select("fn", F.lit("CALL_ARG_PORT").alias("kind"), (F.col("__base") + F.col("idx")).alias("index"), "value", "type", F.col("id").alias("callsite"))
    return made.drop("__base"), ports


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges (fn, src, dst, via_alias) with ``position``, by which they are written: by source, target, and without alias first."""
    return edges.withColumn("position", F.row_number().over(Window.partitionBy("fn").orderBy("src", "dst", "via_alias")) - 1)


def received(values: DataFrame, instr: DataFrame, operand: DataFrame) -> DataFrame:
    """(fn, value, message): the messages that a call's value (fn, value, is_tuple) delivers: its first part if it has several, else itself."""
    parts = operands(instr.where("op = 'Extract' AND field_idx = 0"), operand).select("fn", F.col("arg").alias("value"), F.col("value").alias("part"))
    first = values.where("is_tuple").join(parts, ["fn", "value"]).select("fn", "value", F.col("part").alias("message"))
    return first.unionByName(values.where("NOT is_tuple").select("fn", "value", F.col("value").alias("message")))


def topic_cells(messages: DataFrame, payloads: DataFrame) -> DataFrame:
    """Cell vertices of messages sent or received: fn, kind (OUT_FIELD written, IN_GLOBAL read), sym, sym_name, value.

    ``messages`` has fn, role (produce or consume), topics (names), message and type_pkg, type_name of it; ``payloads`` (pkg, name, field) is a fixed
    table. Of a known message type the payload field's values flow, else the message's own. A message of several topics is a cell of each.
    """
    from ..functions import paths

    known = F.broadcast(payloads.select(F.col("pkg").alias("type_pkg"), F.col("name").alias("type_name"), F.col("field").alias("payload")))
    m = messages.join(known, ["type_pkg", "type_name"], "left").withColumn("topic", F.explode(F.array_distinct("topics")))
    name = paths.topic_name(F.col("topic"))
    kind = F.when(F.col("role") == "produce", "OUT_FIELD").otherwise("IN_GLOBAL")
    value = F.when(F.col("payload").isNotNull(), F.concat_ws(".", "message", "payload")).otherwise(F.col("message"))
    return m.select("fn", kind.alias("kind"), ident.contract_iid(name, "kafka").alias("sym"), name.alias("sym_name"), value.alias("value")).distinct()


def heap_cells(fields: DataFrame, types: DataFrame, options: Options = Options()) -> DataFrame:
    """Fields that are program-wide cells, with the identity by which writers and readers join."""
    k = types.select(F.col("type_key").alias("ftype"), F.col("kind").alias("__kind"))
    owner = types.select("type_key", "pkg_path", F.col("name").alias("type_name"))
    f = fields.join(k, "ftype", "left").join(owner, "type_key")
    chosen = F.lit(True) if options.heap_all_fields else F.col("__kind") == "chan"
    if options.drop_ifaces:
        chosen = chosen & (F.coalesce("__kind", F.lit("")) != "interface")
    cells = f.where(F.lit(options.heap_slots) & chosen)
    return cells.select("type_key", "idx", F.concat("type_name", F.lit("."), "name").alias("sym_name"), ident.cell_symbol(F.col("pkg_path"), F.col("type_name"), F.col("idx")).alias("sym"))


def surface_reads(loads: DataFrame, outgoing: DataFrame, fields: DataFrame) -> DataFrame:
    """Loads (fn, value, base, pkg, name, field) of untrusted request fields, but of requests that are sent; their synthetic callee."""
    hit = loads.join(F.broadcast(fields), ["pkg", "name", "field"]).join(outgoing.select("fn", F.col("value").alias("base")).distinct(), ["fn", "base"], "left_anti")
    return hit.select("fn", "value", F.concat(F.lit("read:"), "pkg", F.lit("."), "name", F.lit("."), "field").alias("callee_fqn"))


def constant_function_variables(stores: DataFrame, escapes: DataFrame) -> DataFrame:
    """Globals bound once, in an initialiser, to a function, and never leaked: stores (global, in_init, function or null), escapes (global)."""
    s = stores.groupBy("global").agg(F.count("*").alias("n"), F.max(F.when(F.col("in_init"), F.col("function"))).alias("function"))
    return s.where("n = 1 AND function IS NOT NULL").join(escapes.select("global").distinct(), "global", "left_anti").select("global", "function")


def thunk_methods(thunks: DataFrame, calls: DataFrame) -> DataFrame:
    """A thunk's method if its body has exactly one static callee, else the thunk: thunks (fn), calls (fn, static_callee)."""
    c = calls.where("static_callee IS NOT NULL").groupBy("fn").agg(F.count("*").alias("n"), F.min("static_callee").alias("m"))
    return thunks.join(c, "fn", "left").select("fn", F.when(F.col("n") == 1, F.col("m")).otherwise(F.col("fn")).alias("method"))


def single_stores(stores: DataFrame, uses: DataFrame) -> DataFrame:
    """Local variables with exactly one store and no other use than loads: stores (alloc, value), uses (alloc) that leak."""
    one = stores.groupBy("alloc").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n = 1").select("alloc", "value")
    return one.join(uses.select("alloc").distinct(), "alloc", "left_anti")


def slice_elements(stores: DataFrame, lengths: DataFrame) -> DataFrame:
    """Elements of slice literals in order, where each index is stored exactly once: stores (slice, idx, value), lengths (slice, n)."""
    g = stores.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("e"), F.count("*").alias("stored"), F.countDistinct("idx").alias("different"), F.max("idx").alias("last"))
    ok = (F.col("stored") == F.col("n")) & (F.col("different") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    return g.join(lengths, "slice").where(ok).select("slice", F.transform("e", lambda x: x["value"]).alias("values"))


def field_stores(stores: DataFrame, whole: DataFrame) -> DataFrame:
    """Fields of struct literals stored once, unless the struct is overwritten as a whole: stores (alloc, field, value), whole (alloc)."""
    one = stores.groupBy("alloc", "field").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")
    return one.join(whole.select("alloc").distinct(), "alloc", "left_anti")


def getters(methods: DataFrame, fields: DataFrame, bodies: DataFrame) -> DataFrame:
    """Methods that only return a field of their receiver: Get<Field> without parameters, whose every return is that field and which
    call nothing. methods (fn, type_key, name, n_params), bodies (fn, returns_field_idx or null, calls)."""
    named = methods.where("n_params = 1 AND name LIKE 'Get_%'").withColumn("field_name", F.substring("name", 4, 1 << 20))
    hit = named.join(fields.select("type_key", F.col("name").alias("field_name"), "idx"), ["type_key", "field_name"])
    proof = bodies.groupBy("fn").agg(F.bool_and(~F.col("calls")).alias("calm"), F.min(F.coalesce("returns_field_idx", F.lit(-1))).alias("lo"), F.max(F.coalesce("returns_field_idx", F.lit(-1))).alias("hi"))
    return hit.join(proof, "fn").where("calm AND lo = idx AND hi = idx").select("fn", "type_key", F.col("idx").alias("field_idx"))
