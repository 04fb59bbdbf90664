import warnings

import pytest

from factloom.options import Options
from factloom.plans import extract
from factloom.sources import schema


def test_vta_without_a_call_graph_says_what_it_takes(spark):
    tables = {t: spark.createDataFrame([], schema.PROGRAM[t]) for t in ("cg_edge", "method", "iface_method", "call")}
    with pytest.warns(UserWarning, match="class hierarchy"):
        extract.call_edges(tables, Options())
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        extract.call_edges(tables, Options(dispatch="cha"))
        extract.call_edges({**tables, "cg_edge": spark.createDataFrame([("f", 0, 0, "g")], schema.PROGRAM["cg_edge"])}, Options())
