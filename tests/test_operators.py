import pytest
from pyspark.sql import functions as F

from factloom.operators import census, dispatch, flow, links, routes, satisfaction
from factloom.options import NoContracts, Options
from factloom.rules import client_rules, router_rules, topic_rules


def test_dispatch_caps(spark):
    edges = spark.createDataFrame([("save", f"r{i}") for i in range(2)] * 2 + [("encode", f"c{i:02}") for i in range(12)] + [("one", "x")], "site string, t string")
    got = {r["site"]: r for r in dispatch.targets_at(edges, ["site"], "t").collect()}
    assert got["save"]["targets"] == ["r0", "r1"] and got["save"]["confidence"] == 0.5 and not got["save"]["opaque"]
    assert got["encode"]["capped"] and got["encode"]["targets"] == [] and got["encode"]["confidence"] == 1.0
    assert got["one"]["confidence"] == 1.0
    assert {r["site"] for r in dispatch.targets_at(edges, ["site"], "t", 1).where("capped").collect()} == {"save", "encode"}
    assert dispatch.targets_at(edges.limit(0), ["site"], "t").count() == 0


METHODS = [("A", "Foo", "()", True), ("B", "Foo", "()", False), ("B", "Bar", "()", False), ("Emb", "Foo", "()", True)]
IFACES = [("I", "Foo", "()"), ("J", "Foo", "()"), ("J", "Bar", "()")]


def test_satisfaction(spark):
    m = spark.createDataFrame(METHODS, "type_key string, method_id string, sig string, in_value_set boolean")
    i = spark.createDataFrame(IFACES, "iface_key string, method_id string, sig string")
    assert {tuple(r) for r in satisfaction.satisfies(m, i).collect()} == {("A", "I", False), ("Emb", "I", False), ("B", "I", True), ("B", "J", True)}
    fp = {r["type_key"]: r["msfp"] for r in satisfaction.method_fingerprints(m).collect()}
    assert fp["A"] == fp["Emb"] != fp["B"]
    ifp = {r["iface_key"]: r["ifp"] for r in satisfaction.interface_fingerprints(i).collect()}
    assert ifp["I"] != ifp["J"]


def test_unique_or_refuse(spark):
    m = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    got = {r["k"]: (r["value"], r["outcome"]) for r in satisfaction.unique_or_refuse(m, ["k"], "v", spark.createDataFrame([(1,), (2,), (3,)], "k int")).collect()}
    assert got == {1: ("a", "unique"), 2: (None, "ambiguous"), 3: (None, "unclassified")}


def test_rebind_errors(spark):
    edges = spark.createDataFrame([("f", 0, "g", 1), ("x", 0, "g", 1), ("h", 5, "q", 2)], "caller string, ordinal int, callee string, n_calls int")
    fn = spark.createDataFrame([("f",), ("g",), ("h",)], "fn string")
    calls = spark.createDataFrame([("f", 0), ("h", 0)], "fn string, ordinal int")
    got = {r["check"]: r["n"] for r in links.rebind_errors(edges, fn, calls, fn.limit(0)).collect()}
    assert got == {"unknown_caller": 1, "count_drift": 1, "ordinal_out_of_range": 1, "unknown_callee": 1}


def test_links(spark):
    w = spark.createDataFrame([("c", "T"), ("c", None), ("d", "T")], "cell string, tag string")
    r = spark.createDataFrame([("c", "U"), ("c", "T")], "cell string, tag string")
    assert links.cell_join(w, r, "cell", "tag").count() == 3
    req = spark.createDataFrame([("a/b",), ("./...",), ("a/...",), ("q",)], "k string")
    assert [x["k"] for x in links.missing(req, spark.createDataFrame([("q",)], "k string"), key="k").collect()] == ["a/b"]
    res = spark.createDataFrame([("f", 0, False), ("f", 1, True), ("f", 63, True)], "fn string, i int, e boolean")
    assert links.error_mask(res, "fn", "i", "e").first()["error_results"] == 2
    ends = spark.createDataFrame([("HTTP", "p", "x")] * 2 + [("GRPC", "p", "x")] * 2, "kind string, package string, iid string")
    assert links.distinct_endpoints(ends).count() == 3
    assert census.most_frequent(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), "k", 1).first()["k"] == "b"


def test_rule_tables(spark):
    r = router_rules(spark)
    assert r.select("rule_ord").distinct().count() == 31 and r.where("framework = 'chi' AND name = 'Get'").first()["method"] == "GET"
    assert client_rules(spark).count() == 10 and topic_rules(spark).select("rule_ord").distinct().count() == 11
    calls = spark.createDataFrame([(1, "net/http", "", "Handle"), (2, "x", "", "Handle")], "site int, pkg string, recv string, name string")
    assert [(x["site"], x["default_mux"]) for x in links.first_rule(calls, r, ["pkg", "recv", "name"], ["site"]).collect()] == [(1, True)]


def test_routes(spark):
    regs = spark.createDataFrame(
        [(1, "m", "net/http", "POST /api/users", True, ["*"], "h1", False), (2, "m", "net/http", "/files/", True, ["*"], "h2", False), (3, "c", "chi", "/orders/{id}", False, ["GET"], "h3", False), (4, "g", "gin", "users", False, ["GET"], "h4", False),
         (5, "u", "chi", "/field", False, ["GET"], "h5", False), (6, "m", "chi", "{}", False, ["GET"], "h6", False), (7, None, "net/http", "/x", True, ["*"], "h7", True), (8, "m", "chi", "/none", False, ["GET"], None, False)],
        "reg int, node string, framework string, pattern string, pattern_method boolean, methods array<string>, handler string, default_mux boolean",
    )
    prefixes = spark.createDataFrame([("m", 1, ""), ("c", 2, "/v1"), ("g", 3, "/v1")], "node string, obj int, prefix string")
    mounted = spark.createDataFrame([(2, "/chi", "/chi")], "obj int, route string, stripped string")
    got = {r["handler"]: r["name"] for r in routes.routes(regs, prefixes, mounted, prefixes.select("node").limit(0)).collect()}
    assert got == {"h1": "http:POST /api/users", "h2": "http:* /files/{*}", "h3": "http:GET /chi/v1/orders/{}", "h4": "http:GET /v1/users", "h5": "http:GET /field", "h7": "http:* /x"}


def test_client_sites(spark):
    calls = spark.createDataFrame([(1, "{}/api/users", "POST"), (2, "{}/api/users/{}", "GET"), (3, "http://stock:8080/v1/stock/reserve", "POST"), (4, "{}/api/search/{}", "")], "site int, url string, method string")
    s = routes.client_sites(calls)
    assert [r["path"] for r in s.orderBy("site").collect()] == ["/{}/api/users", "/{}/api/users/{}", "/v1/stock/reserve", "/{}/api/search/{}"]
    assert tuple(routes.client_census(s).first()) == (4, 4, 3, 1)


def test_topics_and_contracts(spark):
    c = spark.createDataFrame([(1, True, "orders", "x"), (2, False, "d", "audit"), (3, False, None, None)], "site int, handle_decides boolean, handle_topic string, message_topic string")
    assert [r["topic"] for r in routes.topics(c).orderBy("site").collect()] == ["orders", "audit", None]
    emb = spark.createDataFrame([("S1", "UnimplementedLedgerServer", "x/pb", "pb"), ("S2", "UnsafeLedgerServer", "x/pb", "pb")], "type_key string, embedded string, pb_pkg string, pb_name string")
    meth = spark.createDataFrame([("S1", "Get", "b.Get", "unary"), ("S2", "Get", "a.Get", "unary"), ("S1", "Watch", "b.Watch", "server"), ("S1", "Help", "b.Help", "unary")], "type_key string, name string, decl_fn string, kind string")
    gen = spark.createDataFrame([("x/pb", "Ledger", "Get"), ("x/pb", "Ledger", "Watch")], "pb_pkg string, service string, name string")
    got = {r["full_name"]: (r["handler"], r["server_streaming"]) for r in routes.grpc_methods(emb, meth, gen).collect()}
    assert got == {"pb.Ledger/Get": ("a.Get", False), "pb.Ledger/Watch": ("b.Watch", True)}
    types = spark.createDataFrame([("p", "ResolverRoot", "interface"), ("p", "DirectiveRoot", "struct"), ("p", "ComplexityRoot", "struct"), ("q", "ResolverRoot", "interface")], "pkg_path string, name string, kind string")
    assert [r["pkg_path"] for r in routes.graphql_gate(types).collect()] == ["p"]
    res = spark.createDataFrame([("Query", "Account", ["context.Context", "string"], "f"), ("Account", "ID", ["context.Context", "*Account"], "g")], "type_name string, method string, params array<string>, decl_fn string")
    disp = spark.createDataFrame([("Query", "Account", "acct")], "type_name string, method string, field string")
    assert {(r["type_field"], tuple(r["arg_params"])) for r in routes.graphql_fields(res, disp).collect()} == {("Query.acct", (1,)), ("Account.id", ())}
    vals = spark.createDataFrame([("a", "convert", "b"), ("b", "phi", "c"), ("b", "phi", "d"), ("e", "convert", "c")], "value string, op string, arg string")
    fns = spark.createDataFrame([("c", "f1"), ("d", "f2")], "value string, fn string")
    assert {r["value"] for r in routes.resolve_handlers(vals, fns).collect()} == {"c", "d", "e"}
    with pytest.raises(NoContracts):
        routes.zero_boundary({"grpc": 0, "http": 0}, True)


INSTR = "fn string, block int, ord int, op string, value string, type string, field_idx int, aux string"
OPERAND = "fn string, block int, ord int, pos int, value string"


def test_flow_edges_and_options(spark):
    ins = spark.createDataFrame([("f", 0, 0, "FieldAddr", "t0", "", 1, ""), ("f", 0, 1, "Store", None, "", None, ""), ("f", 0, 2, "MapUpdate", None, "", None, ""), ("f", 0, 3, "Return", None, "", None, "")], INSTR)
    opd = spark.createDataFrame([("f", 0, 0, 0, "req"), ("f", 0, 1, 0, "t0"), ("f", 0, 1, 1, "x"), ("f", 0, 2, 0, "m"), ("f", 0, 2, 1, "k"), ("f", 0, 2, 2, "x"), ("f", 0, 3, 0, "m")], OPERAND)
    none = spark.createDataFrame([("k", "string", "v")], "value string, kind string, literal string")
    e = {(r["src"], r["dst"], r["op"], r["field"]) for r in flow.value_edges(ins, opd, none).collect()}
    assert e == {("req", "t0", "proj", 1), ("t0", "req", "inject", 1), ("x", "t0", "plain", None), ("x", "m", "plain", None)}
    off = {(r["src"], r["dst"]) for r in flow.value_edges(ins, opd, none, Options(container_writes=False)).collect()}
    assert off == {("req", "t0"), ("t0", "req"), ("x", "t0")}
    p = spark.createDataFrame([("f", 0, "a", "T"), ("f", 1, "b", "T")], "fn string, idx int, value string, type string")
    assert [(r["index"], r["value"]) for r in flow.input_vertices(p, p.where("idx = 0").withColumn("value", F.lit("free"))).orderBy("index").collect()] == [(0, "a"), (1, "b"), (2, "free")]
    assert flow.input_vertices(p, p, Options(closure_flow=False)).count() == 2


def test_call_site_ladder(spark):
    calls = spark.createDataFrame(
        [("f", 0, 0, "Call", True, "x.io/pb.LedgerClient", "Get", None, None, False), ("f", 0, 1, "Go", True, "x.Repo", "Save", None, None, False), ("f", 0, 2, "Call", False, None, None, "g", None, False), ("f", 0, 3, "Call", False, None, None, None, "fv", False), ("f", 0, 4, "Defer", False, None, None, "g", None, False), ("f", 0, 5, "Call", True, "x.Repo", "None", None, None, False)],
        "fn string, block int, ord int, kind string, is_invoke boolean, iface_type string, method string, static_callee string, func_value string, is_builtin boolean",
    )
    fns = spark.createDataFrame([("g", "x.g", "")], "fn string, fqn string, recv_type string")
    targets = spark.createDataFrame([("f", 0, 1, ["a", "b"], False, 0.5)], "fn string, block int, ord int, targets array<string>, capped boolean, confidence double")
    got = {r["id"]: (r["kind"], r["opaque"], r["dispatch_confidence"]) for r in flow.call_sites(calls, fns, targets).collect()}
    assert got == {0: ("INVOKES_REMOTE", False, 1.0), 1: ("VIRTUAL", False, 0.5), 2: ("STATIC", False, 1.0), 3: ("STATIC", True, 1.0), 4: ("DEFER", False, 1.0), 5: ("VIRTUAL", False, 1.0)}


def test_single_assignments(spark):
    st = spark.createDataFrame([("g1", True, "f"), ("g2", True, "f"), ("g2", False, None), ("g3", True, "f"), ("g4", False, "f")], "global string, in_init boolean, function string")
    assert [r["global"] for r in flow.constant_function_variables(st, spark.createDataFrame([("g3",)], "global string")).collect()] == ["g1"]
    th = spark.createDataFrame([("t1", "m"), ("t2", "m"), ("t2", "n")], "fn string, static_callee string")
    assert {tuple(r) for r in flow.thunk_methods(th.select("fn").distinct(), th).collect()} == {("t1", "m"), ("t2", "t2")}
    sl = spark.createDataFrame([("s", 1, "b"), ("s", 0, "a"), ("r", 0, "a"), ("r", 0, "b")], "slice string, idx int, value string")
    got = flow.slice_elements(sl, spark.createDataFrame([("s", 2), ("r", 2)], "slice string, n int")).collect()
    assert [(r["slice"], r["values"]) for r in got] == [("s", ["a", "b"])]
    fields = spark.createDataFrame([("T", 0, "ch", "chan T", "", False), ("T", 1, "x", "int", "", False)], "type_key string, idx int, name string, ftype string, tag string, embedded boolean")
    types = spark.createDataFrame([("T", "p", "T", "struct"), ("chan T", "p", "", "chan"), ("int", "", "int", "basic")], "type_key string, pkg_path string, name string, kind string")
    assert flow.heap_cells(fields, types).count() == 0
    assert [r["sym_name"] for r in flow.heap_cells(fields, types, Options(heap_slots=True)).collect()] == ["T.ch"]
    assert flow.heap_cells(fields, types, Options(heap_slots=True, heap_slots_scope="all")).count() == 2
