import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import classify, ident, paths
from factloom.functions import strings as S

CANON = {
    "/api/users/{id}": "/api/users/{}", "/api/users/:id": "/api/users/{}", "/api/users/{id:[0-9]+}": "/api/users/{}", "/users/[id]/posts": "/users/{}/posts", "/files/{path...}": "/files/{*}",
    "/static/*filepath": "/static/{*}", "/static/*": "/static/{*}", "/blog/[...slug]": "/blog/{*}", "/docs/[[...slug]]": "/docs/{*}", "/a/{*}/b": "/a/{*}", "/users/{$}": "/users", "/v{}.json": "/{}",
    "https://api.example.com/v1/users?x=1#frag": "/v1/users", "HTTP://localhost:8080": "/", "//cdn.example.com/a": "/a", "{}/api/users/{}": "/{}/api/users/{}", "{}": "/{}", "/api//users/": "/api/users",
    "api/users": "/api/users", "/search?q={}": "/search", "": "/", "/": "/",
}


def column(spark, values, f):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], ["i", *[f"c{k}" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)]])
    return [r["x"] for r in df.select("i", f.alias("x")).orderBy("i").collect()]


def test_canonical_paths(spark):
    got = column(spark, list(CANON), paths.canon_path(F.col("c0")))
    assert dict(zip(CANON, got)) == CANON
    assert column(spark, got, paths.canon_path(F.col("c0"))) == got


def test_join_path(spark):
    rows = [("/api", "{}", False, "/api/{}"), ("/api/{}", "/mid", False, "/api/{}/mid"), ("/v{}", "/x", False, "/v{}/x"), ("/v1", "users", True, "/v1/users"), ("/eg", "users", False, "/egusers"), ("/v1/", "/users", True, "/v1//users"), ("", "/x", False, "/x"), ("{}", "/x", False, "{}/x"), ("/a", "", True, "/a")]
    assert column(spark, rows, paths.join_path(F.col("c0"), F.col("c1"), F.col("c2"))) == [r[3] for r in rows]


def test_patterns(spark):
    rows = {"GET /x": ("GET", "/x"), "POST  example.com/a/": ("POST", "/a/"), "example.com/x": ("", "/x"), "example.com": ("", ""), "/x": ("", "/x"), "{}/x": ("", "{}/x"), "GET {}/x": ("GET", "{}/x")}
    assert column(spark, list(rows), paths.pattern_method(F.col("c0"))) == [m for m, _ in rows.values()]
    assert column(spark, list(rows), paths.pattern_path(F.col("c0"))) == [p for _, p in rows.values()]
    sub = {"/static/": "/static/{*}", "/": "/{*}", "/x": "/x", "/x/{$}": "/x/{$}"}
    assert column(spark, list(sub), paths.subtree(F.col("c0"))) == list(sub.values())


def test_text_functions(spark):
    assert column(spark, ["/a/%s/b", "%d%%", "x%", "%s%v", "%[1]s-%05.2f"], paths.sprintf_template(F.col("c0"))) == ["/a/{}/b", "{}%", "x{}", "{}", "{}-{}"]
    assert column(spark, ["ID", "URLField", "Name", "x", "", "HTTPServer"], paths.lcfirst(F.col("c0"))) == ["id", "urlField", "name", "x", "", "httpServer"]
    assert column(spark, ["//a///b", "x"], paths.display(F.col("c0"))) == ["/a/b", "/x"]
    assert column(spark, ["{}api/users", "{}/x", "{}?q", "/a", "{}"], paths.client_path(F.col("c0"))) == ["{}/api/users", "{}/x", "{}?q", "/a", "{}"]
    assert column(spark, ["/r/a/b.go", "/q/b.go"], paths.relative_file(F.col("c0"), F.lit("/r"))) == ["a/b.go", "/q/b.go"]
    assert column(spark, ["a, b ,", ""], paths.scope_list(F.col("c0"))) == [["a", "b"], ["./..."]]
    assert column(spark, ["/a/{}", "/{}/{*}", "/"], paths.has_literal_segment(F.col("c0"))) == [True, False, False]
    assert column(spark, [('protobuf:"bytes,3,opt,name=x"', 0), ("json", 7)], paths.field_id(F.col("c0"), F.col("c1").cast("int"))) == [3, 7]


def framed(x: str, order: str = "little") -> bytes:
    return len(x.encode()).to_bytes(8, order) + x.encode()


@pytest.mark.parametrize("text", ["", "abc", "é😀" * 200])
def test_identities(spark, text):
    assert column(spark, [text], ident.iid("o", "p", F.col("c0"), "s")) == [hashlib.sha256(framed("o") + framed("p") + framed(text) + framed("s")).hexdigest()]
    assert column(spark, [text], ident.digest(F.col("c0"), endian="big")) == [hashlib.sha256(framed(text, "big")).hexdigest()]
    assert column(spark, [text], ident.contract_iid(F.col("c0"), "grpc")) == [hashlib.sha256(framed("") * 2 + framed(text) + framed("grpc")).hexdigest()]


def test_body_id_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "b", ["x", "a"]), (2, "b", ["a", "x"]), (3, "b", ["a", "a", "x"])], "i int, b string, c array<string>")
    got = [r["h"] for r in df.select("i", ident.body_id(F.col("b"), F.transform("c", lambda x: x.cast("binary"))).alias("h")).orderBy("i").collect()]
    assert got[0] == got[1] == hashlib.sha256(framed("b") + framed("a") + framed("x")).hexdigest() != got[2]


def test_classification(spark):
    c = F.col("c0")
    pb = {"x.io/pb": True, "x.io/pb/ledger": True, "x.io/api/v1": True, "x.io/pbx": False, "x.io/apis": False, "pb": False}
    assert column(spark, list(pb), classify.pb_match(c)) == list(pb.values())
    head = "// Code generated by "
    mocks = {head + "MockGen. DO NOT EDIT.": True, head + "mockery v2.43.0. DO NOT EDIT.": True, head + "mockery; DO NOT EDIT.": True, head + "http://github.com/gojuno/minimock (x). DO NOT EDIT.": True, head + "counterfeiter. DO NOT EDIT.": True, head + "moq; DO NOT EDIT.": True, head + "moqs. DO NOT EDIT.": False, head + "mockeryfoo. DO NOT EDIT.": False, head + "minimocker. DO NOT EDIT.": False, head + "protoc. DO NOT EDIT.": False, head + "mockery.": False}
    assert column(spark, list(mocks), classify.mock_header(c)) == list(mocks.values())
    assert column(spark, ["a/x_mock.go", "zzz_a.go", "a/x.go"], classify.mock_file_name(c)) == [True, True, False]
    assert column(spark, [("m.io/a", "m.io"), ("fmt", "m.io"), ("m.iox/a", "m.io"), ("net/http", "m.io")], classify.origin(c, F.col("c1"))) == ["USER", "STDLIB", "DEP", "STDLIB"]
    assert column(spark, ["a.pb.go", "x.generated.go", "a/models_gen.go", "m_mock.go", "a.go"], classify.generator(c, classify.mock_file_name(c))) == ["PROTOC", "GQLGEN", "GQLGEN", "MOCKGEN", "NONE"]
    client = [("x.io/pb", "LedgerClient"), ("x.io/pb", "Client"), ("x.io/db", "LedgerClient"), ("x.io/pb", "A_BClient")]
    assert column(spark, client, classify.grpc_client(c, F.lit("pb"), F.col("c1"), F.lit("Get"))) == ["pb.Ledger/Get", None, None, None]
    stream = [("x.io/pb", "L_WatchServer", "Send"), ("x.io/pb", "L_WatchClient", "CloseAndRecv"), ("x.io/pb", "L_WatchClient", "Header"), ("x.io/pb", "LServer", "Send")]
    got = column(spark, stream, classify.stream_port(c, F.lit("pb"), F.col("c1"), F.col("c2")))
    assert [x and tuple(x) for x in got] == [("pb.L/Watch", "SEND", False), ("pb.L/Watch", "RECV", True), None, None]
    assert column(spark, ["func(w net/http.ResponseWriter, r *net/http.Request)"], classify.signature_shape(c)) == ["func(net/http.ResponseWriter, *net/http.Request)"]
    assert column(spark, [("database/sql", "NullString"), ("github.com/guregu/null/v4", "Int"), ("x/null", "Int")], classify.null_wrapper(c, F.col("c1"))) == [True, True, False]
    assert column(spark, ["UnimplementedLedgerServer", "UnsafeXServer", "Server"], classify.server_embed(c)) == ["Ledger", "X", ""]
    with pytest.raises(ValueError):
        classify.segments("a/b")


def test_abstract_strings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    hole, env = S.unknown(F.lit("param")), S.env_symbol(F.lit("ENV"))
    s = S.concat(S.concat(hole, S.unknown(F.lit("other"))), S.concat(S.literal(F.lit("/api")), S.literal(F.lit("/users"))))
    assert value(S.template(s)) == "{}/api/users" and value(S.known(s)) is None and value(F.size(s)) == 2
    assert value(S.leading_hole(s)) and value(S.first_cause(s)) == "param" and value(S.template(S.trim_leading_hole(s))) == "/api/users"
    t = S.concat(env, S.literal(F.lit(".orders")))
    assert value(S.symbol(t)) == "${env:ENV}.orders" and value(S.template(t)) == "{}.orders" and value(S.symbol(hole)) is None
    assert value(S.known(S.literal(F.lit("env:ORDERS")))) == "env:ORDERS" and value(F.size(S.literal(F.lit("")))) == 0
    assert value(S.equal(hole, S.unknown(F.lit("other")))) and not value(S.equal(hole, env)) and value(S.ends_with_slash(S.literal(F.lit("/a/"))))
    assert value(S.template(S.joined(S.literal(F.lit("/v1")), S.literal(F.lit("users")), F.lit(True)))) == "/v1/users"
    assert value(S.template(S.joined(S.literal(F.lit("/api")), hole, F.lit(False)))) == "/api/{}"
