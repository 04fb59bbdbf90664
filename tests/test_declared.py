"""Operators on what a program declares and calls that no query runs, on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom import options
from factloom.operators import flow, links, routes, signatures
from factloom.sources import program, snapshots

def test_toolchain_guard_and_stale_checkout(spark):
    errors = spark.createDataFrame([("a", "undefined: x"), ("b", "package requires newer Go version go1.99")], "pkg_path string, message string")
    program.toolchain_guard(errors.where("pkg_path = 'a'"))
    with pytest.raises(program.ProgramError, match="toolchain skew: b"):
        program.toolchain_guard(errors)
    commits = spark.createDataFrame([("a" * 40, None, False)], "commit_sha string, parent_sha string, dirty boolean")
    assert program.stale_checkout(commits, "a" * 40) == "" and "aaaaaaaa" in program.stale_checkout(commits, "b" * 40)
    assert program.stale_checkout(commits.limit(0), "b" * 40) == ""


def test_version_and_differences(spark):
    assert options.version("x", "9") == f"x {options.VERSION} (spark 9)"
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    assert links.differences(a, a).isEmpty()
    assert sorted(tuple(r) for r in links.differences(a, spark.createDataFrame([(1,), (3,)], "v int")).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_package_shards(spark):
    one = spark.createDataFrame([("p", 2), ("p", 1), ("q", 3)], "pkg string, x int")
    rows = {r.pkg: r for r in snapshots.package_shards(one, one.where("pkg = 'q'"), one.limit(0), one.where("pkg = 'r'")).collect()}
    assert [x.x for x in rows["p"].callers] == [1, 2] and rows["p"].types is None and [x.x for x in rows["q"].types] == [3] and set(rows) == {"p", "q"}


def test_handlers(spark):
    regs = spark.createDataFrame([(1, ["p", "h"], None, 1, False), (2, ["p", "s"], ["m", "h"], 1, True), (3, ["p"], None, 1, False), (4, ["p", "s"], None, 1, True), (5, ["p", "s"], [], 1, True)], "reg int, args array<string>, elements array<string>, handler_arg int, last_handler boolean")
    assert {r.reg: r.handler for r in routes.handler_argument(regs).collect()} == {1: "h", 2: "h", 3: None, 4: None, 5: None}


def test_body_identity_ignores_names_and_places(spark):
    spec = "fn string, vertices array<struct<id:int,kind:string,span:string,field_names:array<string>>>, edges array<struct<src:int,dst:int>>, callsites array<struct<id:int,callee_iids:array<string>,target_fqns:array<string>,span:string>>"
    rows = [("a", [(0, "IN", "x.go:1", ["F"])], [(0, 1)], [(0, ["i"], ["t"], "s")]), ("b", [(0, "IN", "y.go:9", ["G"])], [(0, 1)], [(0, ["j"], ["u"], "z")]), ("c", [(1, "IN", "x.go:1", ["F"])], [(0, 1)], [(0, ["i"], ["t"], "s")])]
    got = {r.fn: bytes(r.canonical) for r in signatures.canonical_flow(spark.createDataFrame(rows, spec)).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_received_messages(spark):
    instr = spark.createDataFrame([("f", 0, 1, "Extract", "m0", None, 0, None), ("f", 0, 2, "Extract", "m1", None, 1, None)], "fn string, block int, ord int, op string, value string, type string, field_idx int, aux string")
    operand = spark.createDataFrame([("f", 0, 1, 0, "c"), ("f", 0, 2, 0, "c")], "fn string, block int, ord int, pos int, value string")
    values = spark.createDataFrame([("f", "c", True), ("f", "d", False)], "fn string, value string, is_tuple boolean")
    assert sorted(tuple(r) for r in flow.received(values, instr, operand).collect()) == [("f", "c", "m0"), ("f", "d", "d")]


def test_copies_have_no_number_with_heap_slots(spark):
    calls = spark.createDataFrame([("f", 0, 0, True, "copy", 2, False), ("f", 0, 1, True, "len", 1, False), ("f", 0, 2, False, None, 2, True)], "fn string, block int, ord int, is_builtin boolean, func_value string, n_args int, is_invoke boolean")
    assert flow.emitted_calls(calls).count() == 3 and [r.ord for r in flow.emitted_calls(calls, options.Options(heap_slots=True)).orderBy("ord").collect()] == [1, 2]


def test_nested_aliases_and_channels(spark):
    none = []
    rows = [("int", "basic", "int", None, none, none), ("e", "interface", None, None, none, none), ("a1", "alias", "A", None, ["a2"], none), ("a2", "alias", "B", None, ["int"], none), ("c", "chan", "recv", None, ["a1"], none), ("cc", "chan", "both", None, ["c"], none), ("s", "chan", "send", None, ["cc"], none),
            ("arr", "array", None, 3, ["a1"], none), ("f", "func", None, 1, ["arr", "int", "e"], none), ("loop", "pointer", None, None, ["loop"], none), ("up", "pointer", None, None, ["gone"], none)]
    got = {r.type_key: r.text for r in signatures.canonical_types(spark.createDataFrame(rows, "type_key string, kind string, name string, size int, children array<string>, labels array<string>")).collect()}
    assert got == {"int": "int", "e": "any", "a1": "int", "a2": "int", "c": "<-chan int", "cc": "chan (<-chan int)", "s": "chan<- chan (<-chan int)", "arr": "[3]int", "f": "func([3]int) (int, any)"}


def test_ordered(spark):
    r = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y")], "iid string, handler string")
    assert [tuple(x) for x in routes.ordered_routes(r).collect()] == [("a", "y"), ("a", "z"), ("b", "x")]
    assert [tuple(x) for x in routes.ordered_fields(r.select(F.col("iid").alias("type_field"), F.col("handler").alias("resolver"))).collect()] == [("a", "y"), ("a", "z"), ("b", "x")]
