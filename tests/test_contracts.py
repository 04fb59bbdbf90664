"""Contracts of a small program: an HTTP server with groups, a gRPC service, a client call and a closure."""

import pytest

from factloom.options import Options
from factloom.plans import extract
from factloom.sources import schema

GIN, CHI = "github.com/gin-gonic/gin", "github.com/go-chi/chi/v5"


def write_program(spark, folder):
    call = lambda ord_, callee, invoke=False, iface=None, method=None: ("main", 0, ord_, "Call", invoke, iface, method, callee, None, False)
    lib = lambda fn, pkg, recv: (fn, pkg, None, f"{pkg.split('/')[-1]}.{fn.split('.')[-1]}", "func()", recv, True, None, [], None, 1, 1)
    own = lambda fn, sig: (fn, "m/a", None, f"a.{fn}", sig, None, True, None, [], "a.go", 1, 1)
    res = lambda ord_, value, op="Call", aux="": ("main", 0, ord_, op, value, "", None, aux)
    ops = lambda ord_, *values: [("main", 0, ord_, k, v) for k, v in enumerate(values)]
    rows = {
        "pkg": [("m/a", "a", "m", True, 0, True)] + [(p, p, p, False, 0, False) for p in ("net/http", GIN, CHI, "m/api/pb")],
        "src_file": [("m/a", "a.go", [], False)],
        "func": [own("main", "func()"), own("list", "func(w net/http.ResponseWriter, r *net/http.Request)"), own("get", "func(*gin.Context)"), own("srv.Pay", "func(context.Context, *m/api/pb.Req) (*m/api/pb.Resp, error)"), own("main$1", "func()"), own("subs", "func(r chi.Router)"),
                 lib("mux", "net/http", None), lib("newmux.NewServeMux", "net/http", None), lib("mux.HandleFunc", "net/http", "*net/http.ServeMux"), lib("http.Get", "net/http", None), lib("gin.New", GIN, None), lib("rg.Group", GIN, "*gin.RouterGroup"), lib("rg.GET", GIN, "*gin.RouterGroup"),
                 lib("chi.NewRouter", CHI, None), lib("cm.Route", CHI, "*chi.Mux"), lib("cr.Post", CHI, "chi.Router"), lib("cm.Mount", CHI, "*chi.Mux")],
        "param": [("list", 0, "w", "net/http.ResponseWriter"), ("list", 1, "r", "*net/http.Request"), ("get", 0, "c", "*github.com/gin-gonic/gin.Context"), ("srv.Pay", 0, "ctx", "context.Context"), ("srv.Pay", 1, "req", "*m/api/pb.Req"), ("subs", 0, "sr", "chi.Router"), ("main", 0, "base", "string")],
        "free_var": [("main$1", 0, "x", "int")],
        "const": [(f"c{k}", "string", t) for k, t in enumerate(["GET /users/{id}", "/v1", "/items", "http://svc/status", "/sub", "/new", "/in"])],
        "type": [("T", "m/a", "server", "struct", None, None, 0), ("E", "m/api/pb", "UnimplementedPayServer", "struct", None, None, 0), ("I", "m/api/pb", "PayServer", "interface", None, None, 0), ("R", "m/api/pb", "Req", "struct", None, None, 0)],
        "field": [("T", 0, "UnimplementedPayServer", "E", "", True)],
        "method": [("T", "Pay", "Pay", "()", True, "srv.Pay"), ("T", "Other", "Other", "()", True, "list")],
        "iface_method": [("I", "Pay", "Pay", "()")],
        "call": [call(0, "newmux.NewServeMux"), call(1, "mux.HandleFunc"), call(2, "gin.New"), call(3, "rg.Group"), call(4, "rg.GET"), call(6, "http.Get"), call(7, "chi.NewRouter"), call(8, "cm.Route"), call(10, "chi.NewRouter"), call(11, "cm.Mount"), ("subs", 0, 0, "Call", False, None, None, "cr.Post", None, False)],
        "instr": [res(0, "mux"), res(2, "engine"), res(3, "v1"), res(5, "cl", "MakeClosure", "main$1"), res(6, "resp"), res(7, "cmux"), res(9, "url", "BinOp", "+"), res(10, "inner")],
        "operand": ops(0, "newmux.NewServeMux") + ops(1, "mux.HandleFunc", "mux", "c0", "list") + ops(2, "gin.New") + ops(3, "rg.Group", "engine", "c1") + ops(4, "rg.GET", "v1", "c2", "mw", "get") + ops(5, "resp") + ops(6, "http.Get", "url") + ops(7, "chi.NewRouter")
        + ops(8, "cm.Route", "cmux", "c4", "subs") + ops(9, "base", "c3") + ops(10, "chi.NewRouter") + ops(11, "cm.Mount", "cmux", "c6", "inner") + [("subs", 0, 0, 0, "cr.Post"), ("subs", 0, 0, 1, "sr"), ("subs", 0, 0, 2, "c5"), ("subs", 0, 0, 3, "list")],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, schema.PROGRAM[name]).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def program(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("program"))
    write_program(spark, folder)
    return folder


def test_contracts_of_a_program(spark, program):
    out = extract.extract(spark, program, Options(repo="r"))
    found = {(r["kind"], r["name"], r["handler"], tuple(r["params"] or ())) for r in out["contract"].collect()}
    assert found == {
        ("GRPC", "pb.Pay/Pay", "srv.Pay", (1,)),
        ("HTTP", "http:GET /users/{}", "list", (1,)),
        ("HTTP", "http:GET /v1/items", "get", (0,)),
        ("HTTP", "http:POST /sub/new", "list", (1,)),
    }
    calls = [(r["fn"], r["ord"], r["method"], r["dynamic_base"]) for r in out["http_call"].collect()]
    assert calls == [("main", 6, "GET", True)]
    # a closure is a site after all calls, with the captured value as its argument
    made = out["callsite"].where("fn = 'main' AND callee_fqn = 'main$1'").collect()
    assert [(r["id"], r["kind"], r["resultc"]) for r in made] == [(10, "STATIC", 0)]
    port = out["vertex"].where("fn = 'main' AND kind = 'CALL_ARG_PORT' AND callsite = 10").collect()
    assert [(r["index"], r["value"]) for r in port] == [(0, "resp")]
    # the result of the client call flows into the closure
    assert out["edge"].where("fn = 'main' AND to_callsite = 10 AND from_kind = 'CALL_RESULT_PORT'").count() == 1


def test_options_switch_boundaries_off(spark, program):
    off = extract.extract(spark, program, Options(repo="r", http_routes=False, http_calls=False, closure_flow=False))
    assert {r["kind"] for r in off["contract"].collect()} == {"GRPC"} and off["http_call"].isEmpty()
    assert off["callsite"].where("callee_fqn = 'main$1'").isEmpty()
