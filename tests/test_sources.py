import pytest
from pyspark.sql import functions as F

from factloom.options import NoContracts, Options, UsageError, exit_code
from factloom.sources import facts, program, schema, snapshots, wire

PACKAGE = {
    "repo": "m.io/r", "commit_sha": "c", "package_path": "m.io/r/app", "schema_version": 3, "language": "go",
    "functions": [{
        "id": {"iid": b"\x01" * 32, "bid": b"\x02"}, "fqn": "app.F", "package": "m.io/r/app", "origin": "DEP", "generated": False, "generator": "NONE", "has_body": True, "span": {"file": "a.go", "line": 300, "col": -1},
        "signature": {"params": [{"name": "x", "type": "T", "by_ref": True}], "has_receiver": False, "returns": [{"type": "error"}], "variadic": False},
        "flow": {"vertices": [], "edges": [{"src": 1, "dst": 2, "via_alias": True}], "callsites": [{
            "id": 7, "kind": "VIRTUAL", "callee_iids": [b"\x01", b"\x02"], "opaque": False, "callee_fqn": "q", "argc": 2, "arg0_is_receiver": True, "resultc": 1, "span": None, "dispatch_confidence": 0.5, "stream_op": "RECV",
            "stream_client_side": True, "error_results": 1 << 62, "arg_names": [], "http_call": {"method": "", "path": "/x"}, "target_fqns": ["é"]}]},
        "binds_to": [], "source_params": [0, 300]}],
    "types": [], "proto_messages": [], "grpc_methods": [], "graphql_fields": [],
    "endpoints": [{"iid": b"e", "kind": "MESSAGE", "untrusted_input": True, "name": "orders"}],
    "http_routes": [{"iid": b"r", "method": "GET", "path": "/a", "display": "/a", "handler_iid": b"\x01" * 32, "endpoint_iid": b"r", "request_params": [1], "framework": "chi"}],
}


def test_wire_round_trip():
    data = wire.encode("Package", PACKAGE)
    assert wire.decode("Package", data) == PACKAGE and wire.encode("Package", wire.decode("Package", data)) == data
    assert wire.decode("FlowEdge", b"\x08\x01\x10\x02\x18\x01\xfa\x06\x02hi") == {"src": 1, "dst": 2, "via_alias": True}
    for damaged in (data[:-1], b"\x0a\xff", b"\x0b"):
        with pytest.raises(ValueError):
            wire.decode("Package", damaged)


def test_fact_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.pb").write_bytes(wire.encode("Package", PACKAGE))
    packages = facts.read_packages(spark, str(tmp_path / "in"))
    assert facts.site_lines(packages).first()["line"] == "app.F\t7\tfalse\t0.5000\t01,02"
    assert {(r["kind"], r["name"], r["handler"]) for r in facts.contract_lines(packages).collect()} == {("ENDPOINT", "orders", ""), ("HTTP", "/a", "app.F")}
    assert facts.function_lines(packages, "app").count() == 1 and facts.function_lines(packages, "zzz").count() == 0
    totals, fanout, conf = facts.statistics(packages)
    assert tuple(totals.first()) == (1, 1, 1, 0) and fanout.first()["fanout"] == 2 and conf.first()["confidence"] == "0.5000"
    written = facts.write_packages(packages, str(tmp_path / "out"))
    assert written.first()["name"] == "m.io_r_app.pb" and bytes(written.first()["content"]) == wire.encode("Package", PACKAGE)
    assert facts.export(spark, written, str(tmp_path / "files")) == 1
    assert (tmp_path / "files" / "m.io_r_app.pb").read_bytes() == wire.encode("Package", PACKAGE)


def test_snapshots(spark, tmp_path):
    edges = spark.createDataFrame([("f", 0, "g", 1)], "caller string, ordinal int, callee string, n_calls int")
    store = snapshots.SnapshotStore(spark, str(tmp_path), Options(repo="r"))
    assert store.probe("c1") == (None, "no snapshot") and store.probe("")[1] == "no commit"
    store.write("c1", {"edges": edges}, fn_set_hash="h")
    tables, why = store.probe("c1")
    assert why == "" and tables["edges"].collect() == edges.collect()
    fn, calls = spark.createDataFrame([("f",), ("g",)], "fn string"), spark.createDataFrame([("f", 0)], "fn string, ordinal int")
    build = lambda: {"edges": edges}
    assert snapshots.replay_or_build(store, "c1", False, "h", build, fn, calls, fn.limit(0))[1] == "replayed"
    assert snapshots.replay_or_build(store, "c1", False, "h", build, fn.limit(0), calls, fn.limit(0))[1].startswith("unknown_caller")
    assert snapshots.replay_or_build(store, "c1", True, "h", build, fn, calls, fn.limit(0))[1] == "bypassed"
    part = next(p for p in tmp_path.rglob("edges/part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    for crc in tmp_path.rglob("edges/.part-*.crc"):
        crc.unlink()
    assert store.probe("c1")[1] == "shard hash mismatch: edges"
    for k in range(9):
        store.write(f"commit{k}", {"edges": edges})
    assert sum(store.probe(f"commit{k}")[0] is not None for k in range(9)) == 8


def test_options():
    assert Options().key() == Options().key()
    base = Options().key()
    for change in ({"scope": "a"}, {"dispatch": "cha"}, {"cap": 4}, {"heap_slots": True}, {"pb_paths": "pb"}, {"dep_bodies": True}, {"byref_out": True}, {"field_paths": False}, {"dependency_sums": "x"}):
        assert Options(**change).key() != base
    assert Options(verbose=True, out="x").key() == base
    assert not Options(heap_iface_narrow=True).narrow and Options(heap_slots=True, heap_iface_narrow=True).narrow_by_identity and not Options(error_results_strict=True).strict_errors
    for bad in ({"mode": "mr"}, {"mode": "x"}, {"dispatch": "x"}, {"heap_slots": True, "heap_slots_scope": "x"}):
        with pytest.raises(UsageError):
            Options(**bad)
    assert [exit_code(e) for e in (None, NoContracts(), UsageError(), RuntimeError())] == [0, 3, 2, 1]


def test_program_guards(spark, tmp_path):
    pk = spark.createDataFrame([("m/a", "a", "m", True, 0, True), ("m/b", "b", "m", True, 2, True), ("d/x", "x", "d", False, 0, False), ("d/mock_x", "mock_x", "d", False, 0, False)], schema.PROGRAM["pkg"])
    files = spark.createDataFrame([("m/a", "a.go", ["// Code generated by MockGen. DO NOT EDIT."], False), ("m/b", "b.go", None, False), ("m/b", "b_test.go", None, True)], schema.PROGRAM["src_file"])
    assert [r["file"] for r in program.mock_files(files).collect()] == ["a.go"]
    mocks = program.mock_packages(pk, files)
    assert {r["pkg_path"] for r in mocks.collect()} == {"m/a", "d/mock_x"}
    assert [r["pkg_path"] for r in program.dependencies(pk, mocks).collect()] == ["d/x"]
    program.guard(pk, ["m/a", "./..."])
    with pytest.raises(program.ProgramError, match="never built: m/zzz"):
        program.guard(pk, ["m/zzz"])
    program.guard(pk, ["m/zzz"], allow_missing=True)
    with pytest.raises(program.ProgramError, match="errors"):
        program.guard(pk.where("pkg_path = 'm/b'"), ["m/b"])
    with pytest.raises(program.ProgramError, match="nothing matched"):
        program.guard(pk.limit(0), ["m/b"])
    with pytest.raises(program.ProgramError):
        program.read(spark, str(tmp_path / "none"))
    pk.write.parquet(str(tmp_path / "p" / "pkg.parquet"))
    assert program.read(spark, str(tmp_path / "p"))["pkg"].count() == 4
    fns = spark.createDataFrame([("f", "i1", "b1", "a.go"), ("g", "i2", "b2", "b.go")], "fqn string, iid string, bid string, file string")
    diff = spark.createDataFrame([("x", "y", "b.go"), ("x", "z", "a.go")], schema.PROGRAM["git_diff"])
    assert program.manifest(fns, diff, "x", "y").first()["manifest"] == '{"mode":"mr","base":"x","head":"y","changed_files":["b.go"],"changed_fns":[{"iid":"i2","bid":"b2","fqn":"g","file":"b.go"}]}'
    assert program.has_grpc_server(spark.createDataFrame([("UnimplementedXServer",)], "name string"))
    f = spark.createDataFrame([("f", "m/a", "a.go", True, None, []), ("g", "m/b", "b_test.go", True, None, []), ("h", None, "c.go", True, None, ["T"]), ("q", "d/x", "d.go", True, None, []), ("n", "m/a", "a.go", False, None, [])], "fn string, pkg_path string, file string, has_body boolean, synthetic string, type_args array<string>")
    assert {r["fn"] for r in program.emittable(f, pk, files.where(F.col("is_test")).select("file")).collect()} == {"f", "h"}
