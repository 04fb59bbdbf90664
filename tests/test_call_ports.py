import pytest

from factloom.options import Options, UsageError
from factloom.plans import extract
from factloom.sources import schema


def test_values_cross_calls_at_their_ports(spark, tmp_path):
    # F(a, s): t = g(a); x, y = extract t; z = s.Put(y); return x, z
    rows = {
        "pkg": [("m/a", "a", "m", True, 0, True)],
        "src_file": [("m/a", "a.go", [], False)],
        "func": [(n, "m/a", None, f"a.{n}", "func()", None, True, None, [], "a.go", 1, 1) for n in ("F", "g")],
        "param": [("F", 0, "a", "int"), ("F", 1, "s", "m/a.S")],
        "instr": [("F", 0, 0, "Call", "t", "(int, int)", None, ""), ("F", 0, 1, "Extract", "x", "int", 0, ""), ("F", 0, 2, "Extract", "y", "int", 1, ""), ("F", 0, 3, "Call", "z", "int", None, ""), ("F", 0, 4, "Return", None, "", None, "")],
        "operand": [("F", 0, 0, 0, "g"), ("F", 0, 0, 1, "a"), ("F", 0, 1, 0, "t"), ("F", 0, 2, 0, "t"), ("F", 0, 3, 0, "s"), ("F", 0, 3, 1, "y"), ("F", 0, 4, 0, "x"), ("F", 0, 4, 1, "z")],
        "call": [("F", 0, 0, "Call", False, None, None, "g", None, False), ("F", 0, 3, "Call", True, "m/a.S", "Put", None, None, False)],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, schema.PROGRAM[name]).write.parquet(f"{tmp_path}/p/{name}.parquet")
    edges = extract.extract(spark, f"{tmp_path}/p")["edge"].collect()
    got = {(e.from_kind, e.from_index, e.from_callsite, e.to_kind, e.to_index, e.to_callsite) for e in edges}
    assert got == {
        ("IN_PARAM", 0, None, "CALL_ARG_PORT", 0, 0), ("IN_PARAM", 1, None, "CALL_ARG_PORT", 0, 1), ("CALL_RESULT_PORT", 1, 0, "CALL_ARG_PORT", 1, 1),
        ("CALL_RESULT_PORT", 0, 0, "OUT_RETURN", 0, None), ("CALL_RESULT_PORT", 0, 1, "OUT_RETURN", 1, None),
    }
    assert {e.from_param for e in edges if e.from_kind == "CALL_RESULT_PORT"} == {None}


@pytest.mark.parametrize("option", [{"library_writeback": False}, {"heap_slots": True}, {"mode": "mr", "base": "a", "head": "b"}])
def test_options_without_effect_are_refused(spark, tmp_path, option):
    with pytest.raises(UsageError):
        extract.extract(spark, str(tmp_path), Options(**option))
