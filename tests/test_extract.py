import pytest

from factloom import cli
from factloom.options import Options, UsageError
from factloom.plans import extract
from factloom.sources import schema, wire
from factloom.streaming import refresh

from .test_sources import PACKAGE


def write_program(spark, folder):
    rows = {
        "pkg": [("m/a", "a", "m", True, 0, True), ("x/db", "db", "x", False, 0, False)],
        "src_file": [("m/a", "a.go", [], False), ("m/a", "a_test.go", [], True)],
        "type": [("m/a.Repo", "m/a", "Repo", "interface", None, None, 0), ("*T", "m/a", "", "pointer", "T", None, 0)],
        "method": [(f"m/a.R{k}", "Save", "Save", "()", True, f"R{k}.Save") for k in range(2)],
        "iface_method": [("m/a.Repo", "Save", "Save", "()")],
        "func": [(n, "m/a", None, f"a.{n}", "func()", None, True, None, [], "a.go", 1, 1) for n in ("Search", "R0.Save", "R1.Save")] + [("T", "m/a", None, "a.T", "func()", None, True, None, [], "a_test.go", 1, 1)],
        "param": [("Search", 0, "req", "*T"), ("Search", 1, "q", "int")],
        # returns field 1 of what had q stored in field 1: v = &req.1; *v = q; r = req.1; return r; and req.2 is read besides
        "instr": [("Search", 0, 0, "FieldAddr", "v", "", 1, ""), ("Search", 0, 1, "Store", None, "", None, ""), ("Search", 0, 2, "Field", "r", "", 1, ""), ("Search", 0, 3, "Field", "o", "", 2, ""), ("Search", 0, 4, "Return", None, "", None, "")],
        "operand": [("Search", 0, 0, 0, "req"), ("Search", 0, 1, 0, "v"), ("Search", 0, 1, 1, "q"), ("Search", 0, 2, 0, "req"), ("Search", 0, 3, 0, "req"), ("Search", 0, 4, 0, "r"), ("Search", 0, 4, 1, "o")],
        "call": [("Search", 0, 5, "Call", True, "m/a.Repo", "Save", None, None, False), ("Search", 0, 6, "Call", True, "x/pb.LedgerClient", "Get", None, None, False)],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, schema.PROGRAM[name]).write.parquet(f"{folder}/{name}.parquet")


def test_extraction(spark, tmp_path):
    write_program(spark, str(tmp_path / "p"))
    out = extract.extract(spark, str(tmp_path / "p"), Options(repo="r"))
    assert {r["fn"] for r in out["function"].collect()} == {"Search", "R0.Save", "R1.Save"}
    sites = {r["id"]: (r["kind"], r["targets"], round(r["dispatch_confidence"], 4)) for r in out["callsite"].collect()}
    assert sites == {0: ("VIRTUAL", ["R0.Save", "R1.Save"], 0.5), 1: ("INVOKES_REMOTE", [], 1.0)}
    edges = {(r["from_param"], r["to_index"], tuple(r["path"])) for r in out["edge"].collect()}
    # q reaches the return that reads its field and not the one that reads the other
    assert (1, 0, ()) in edges and not any(p == 1 and t == 1 for p, t, _ in edges)
    off = extract.extract(spark, str(tmp_path / "p"), Options(repo="r", dispatch="off"))
    assert [r["targets"] for r in off["callsite"].where("id = 0").collect()] == [[]]
    one = extract.extract(spark, str(tmp_path / "p"), Options(repo="r", cap=1))
    assert one["callsite"].where("id = 0").first()["opaque"]


def test_command_line(spark, tmp_path, capsys):
    write_program(spark, str(tmp_path / "p"))
    cli.run(["build", str(tmp_path / "p"), "--out", str(tmp_path / "o"), "--repo", "r", "--no-closure-flow"], spark)
    assert "functions=3 sites=2 remote=1" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "o" / "function.parquet")).count() == 3
    with pytest.raises(UsageError):
        cli.run(["build", str(tmp_path / "p")], spark)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pb").write_bytes(wire.encode("Package", PACKAGE))
    for command in ("dump", "sites", "contracts", "stat"):
        cli.run([command, str(tmp_path / "f")], spark)
    text = capsys.readouterr().out
    assert "app.F\t7\tfalse\t0.5000\t01,02" in text and "HTTP\t/a\tapp.F" in text and "sites=1" in text


def test_following_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, commit: (tmp_path / "in" / name).write_bytes(wire.encode("Package", {**PACKAGE, "commit_sha": commit}))
    put("a.pb", "c1")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), True)
    refresh.follow(*args).awaitTermination(60)
    put("b.pb", "c2")
    refresh.follow(*args).awaitTermination(60)
    rows = refresh.current(spark, str(tmp_path / "t")).collect()
    assert [r["commit_sha"] for r in rows] == ["c2"]
