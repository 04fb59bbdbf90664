"""Signatures, canonical type strings and the parameters that requests arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify

#: Levels of a type that are rewritten.
DEPTH = 64


def by_ref_string(type_: Column) -> Column:
    return type_.startswith("*") | type_.startswith("[]") | type_.startswith("map[")


def signatures(functions: DataFrame, params: DataFrame, results: DataFrame) -> DataFrame:
    """(fn, params, has_receiver, returns, variadic) of functions (fn, recv_type, variadic), params and results (fn, idx, name, type).

    The receiver comes first, by the name recv, and is never by reference.
    """
    p = params.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "type"))).alias("__p"))
    r = results.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("idx", "type"))).alias("__r"))
    has = F.coalesce("recv_type", F.lit("")) != ""
    receiver = F.struct(F.lit("recv").alias("name"), F.col("recv_type").alias("type"), F.lit(False).alias("by_ref"))
    own = F.transform(F.coalesce("__p", F.expr("array()").cast("array<struct<idx:int,name:string,type:string>>")), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), by_ref_string(x["type"]).alias("by_ref")))
    returns = F.transform(F.coalesce("__r", F.expr("array()").cast("array<struct<idx:int,type:string>>")), lambda x: F.struct(x["type"].alias("type")))
    joined = functions.join(p, "fn", "left").join(r, "fn", "left")
    return joined.select("fn", F.when(has, F.concat(F.array(receiver), own)).otherwise(own).alias("params"), has.alias("has_receiver"), returns.alias("returns"), F.coalesce("variadic", F.lit(False)).alias("variadic"))


def _indices(hits: DataFrame) -> DataFrame:
    return hits.groupBy("fn").agg(F.array_sort(F.collect_set("idx")).alias("params"))


def request_message_params(params: DataFrame, types: DataFrame, segments=classify.PB_SEGMENTS) -> DataFrame:
    """(fn, params): the parameters (fn, idx, type) that point to a struct of a generated package; the receiver isn't among them."""
    structs = types.where((F.col("kind") == "struct") & classify.pb_match(F.col("pkg_path"), segments)).select(F.concat(F.lit("*"), "pkg_path", F.lit("."), "name").alias("type"))
    return _indices(params.join(structs.distinct(), "type", "left_semi"))


def http_request_params(params: DataFrame, request_types: DataFrame) -> DataFrame:
    """(fn, params): the parameters whose type, or what it points to, carries a request; ``request_types`` (pkg, name) is a fixed table."""
    named = request_types.select(F.concat("pkg", F.lit("."), "name").alias("__named"))
    return _indices(params.withColumn("__named", F.regexp_replace("type", r"^\*", "")).join(F.broadcast(named), "__named", "left_semi"))


def arg_names(args: Column) -> Column:
    """The names of resolver arguments (structs with name), joined."""
    return F.array_join(F.transform(args, lambda a: a["name"]), ",")


def canonical_flow(functions: DataFrame) -> DataFrame:
    """``functions`` (fn, vertices, edges, callsites as arrays of structs) with the bytes that identify a body: what names callees or places
    is left out, as are the names of fields."""

    def without(c: str, gone: set[str]) -> Column:
        fields = [f.name for f in functions.schema[c].dataType.elementType.fields if f.name not in gone]
        return F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(c)

    body = F.struct(without("vertices", {"span", "field_names"}), F.col("edges"), without("callsites", {"callee_iids", "target_fqns", "span"}))
    return functions.withColumn("canonical", F.encode(F.to_json(body), "UTF-8"))


def canonical_types(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(type_key, text): types printed from what they are, so that identical types print alike whoever spelled them.

    ``nodes`` has type_key, kind, name, size, children (type keys in order) and labels (names of fields or methods, by child).
    Kinds: basic, param, named (name; children are type arguments), alias (child), pointer, slice, array (size), map (key, value),
    chan (name both, send or recv), func (children are parameters, then results; size counts the parameters; name variadic), struct and
    interface (labels; an interface's children are its methods' functions). Aliases are resolved, parameters have no names, an interface
    without methods is any. A type is printed in the round after its last child, at most ``depth`` of them.
    """
    from ..plans.storage import written

    def text(c: Column) -> Column:
        inner = lambda first: F.array_join(first, ", ")
        n, k = F.size(c), F.col("size")
        one, two = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        ins, outs = F.slice(c, F.lit(1), F.coalesce(k, F.lit(0))), F.slice(c, F.coalesce(k, F.lit(0)) + 1, F.greatest(n, F.lit(1)))
        last = F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), ins), -1), r"^\[\]", "...")
        ins = F.when((F.col("name") == "variadic") & (F.size(ins) > 0), F.concat(F.slice(ins, F.lit(1), F.size(ins) - 1), F.array(last))).otherwise(ins)
        result = F.when(F.size(outs) == 0, "").when(F.size(outs) == 1, F.concat(F.lit(" "), F.get(outs, F.lit(0)))).otherwise(F.concat(F.lit(" ("), inner(outs), F.lit(")")))
        pairs = F.zip_with("labels", c, lambda a, b: F.concat(a, F.lit(" "), b))
        methods = F.array_sort(F.zip_with("labels", c, lambda a, b: F.concat(a, F.regexp_replace(b, "^func", ""))))
        inner_chan = F.when(one.startswith("<-chan"), F.concat(F.lit("("), one, F.lit(")"))).otherwise(one)
        return (
            F.when(F.col("kind") == "named", F.when(n == 0, F.col("name")).otherwise(F.concat("name", F.lit("["), F.array_join(c, ","), F.lit("]"))))
            .when(F.col("kind").isin("basic", "param"), F.col("name"))
            .when(F.col("kind") == "alias", one)
            .when(F.col("kind") == "pointer", F.concat(F.lit("*"), one))
            .when(F.col("kind") == "slice", F.concat(F.lit("[]"), one))
            .when(F.col("kind") == "array", F.concat(F.lit("["), k.cast("string"), F.lit("]"), one))
            .when(F.col("kind") == "map", F.concat(F.lit("map["), one, F.lit("]"), two))
            .when(F.col("kind") == "chan", F.when(F.col("name") == "recv", F.concat(F.lit("<-chan "), one)).when(F.col("name") == "send", F.concat(F.lit("chan<- "), one)).otherwise(F.concat(F.lit("chan "), inner_chan)))
            .when(F.col("kind") == "func", F.concat(F.lit("func("), inner(ins), F.lit(")"), result))
            .when(F.col("kind") == "struct", F.concat(F.lit("struct{"), F.array_join(pairs, "; "), F.lit("}")))
            .when(F.col("kind") == "interface", F.when(n == 0, "any").otherwise(F.concat(F.lit("interface{"), F.array_join(methods, "; "), F.lit("}"))))
        )

    empty = F.array().cast("array<string>")
    left = nodes.select("type_key", "kind", "name", "size", F.coalesce("children", empty).alias("children"), F.coalesce("labels", empty).alias("labels"))
    done = written(left.where(F.size("children") == 0).select("type_key", text(empty).alias("text")))
    left = written(left.where(F.size("children") > 0))
    for _ in range(depth):
        if left.isEmpty():
            break
        each = left.select("type_key", F.posexplode("children").alias("at", "child")).join(done.select(F.col("type_key").alias("child"), "text"), "child")
        got = each.groupBy("type_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
        ready = left.join(got, "type_key").where(F.size("texts") == F.size("children"))
        more = written(ready.select("type_key", text(F.col("texts")).alias("text")))
        if more.isEmpty():
            break
        left = written(left.join(more, "type_key", "left_anti"))
        done = written(done.unionByName(more))
    return done
