import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.functions import strings as S
from factloom.plans import fixpoint


def fifo(edges, sources):
    """Breadth-first search over (value, path), first arrival decides the alias bit."""
    out = {}
    for source, node, depth in sources:
        seen = {(node, ()): False}
        q = deque(seen)
        while q:
            v, p = q.popleft()
            for src, dst, op, f, alias, _ in edges:
                if src != v:
                    continue
                if op == "plain":
                    n = p
                elif op == "inject":
                    n = (f, *p)[:2]
                elif not p:
                    if depth < 2:
                        continue
                    n = p
                elif p[0] != f:
                    continue
                else:
                    n = p[1:]
                if (dst, n) not in seen:
                    seen[dst, n] = seen[v, p] or alias
                    q.append((dst, n))
        out.update({(source, *k): a for k, a in seen.items()})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_a_queue(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(7), r.randrange(7), r.choice(["plain", "proj", "inject"]), r.randrange(3), r.random() < 0.3, k) for k in range(16)]
    sources = [(100, 0, 0), (101, 1, 2)]
    e = spark.createDataFrame(edges, "src int, dst int, op string, field int, alias boolean, ord long")
    s = spark.createDataFrame(sources, "source int, node int, depth int")
    got = {(x["source"], x["node"], tuple(x["path"])): x["via_alias"] for x in fixpoint.reach_paths(e, s).collect()}
    assert got == fifo(edges, sources)


def test_disjoint_fields_stay_apart(spark):
    # x -> inject 1 -> obj -> proj 1 -> a, and proj 2 -> b
    e = spark.createDataFrame([(0, 1, "inject", 1, False, 0), (1, 2, "proj", 1, False, 1), (1, 3, "proj", 2, False, 2)], "src int, dst int, op string, field int, alias boolean, ord long")
    s = spark.createDataFrame([(9, 0, 0)], "source int, node int, depth int")
    states = fixpoint.reach_paths(e, s)
    assert {x["node"] for x in states.collect()} == {0, 1, 2}
    sinks = spark.createDataFrame([(1, 50), (2, 51)], "node int, sink int")
    got = {(x["src"], x["dst"], tuple(x["path"])) for x in fixpoint.sink_edges(states, sinks, 100).collect()}
    assert got == {(9, 100, (1,)), (9, 51, ())}
    assert {tuple(x["path"]) for x in fixpoint.access_paths(e, s.select(F.col("source"), F.lit(1).alias("node"))).collect()} == {(1,), (2,)}


def test_reachability_and_ancestors(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert {x["node"] for x in fixpoint.reachable(e, spark.createDataFrame([(0, 1)], "source int, node int")).collect()} == {1, 2, 3}
    p = spark.createDataFrame([(k, k - 1 if k else None) for k in range(10)], "node int, parent int")
    assert {tuple(x) for x in fixpoint.ancestors(p).collect()} == {(k, a, k - a) for k in range(10) for a in range(k)}
    assert fixpoint.reachable(e.limit(0), spark.createDataFrame([(0, 1)], "source int, node int")).count() == 1


def test_prefixes_keep_eight_and_mark_the_rest(spark):
    seeds = spark.createDataFrame([(f"r{k}", k, f"/p{k}") for k in range(9)], "node string, obj int, prefix string")
    edges = spark.createDataFrame([(f"r{k}", "join", None, False) for k in range(9)] + [("join", "after", "/x", False), ("loop", "loop", "/y", False)], "src string, dst string, append string, slash boolean")
    facts, lost = fixpoint.prefixes(edges, seeds.unionByName(spark.createDataFrame([("loop", 99, "")], seeds.schema)))
    n = {x["node"]: x["count"] for x in facts.groupBy("node").count().collect()}
    assert n["join"] == n["after"] == 8 and {x["node"] for x in lost.collect()} == {"join", "after", "loop"}
    assert facts.where("node = 'after'").first()["prefix"].endswith("/x")


def test_mounts(spark):
    t = spark.createDataFrame([("root", "", "/api", "a", False, True), ("a", "/v1", "/users", "b", False, True), (None, "", "/lost", "c", False, False), ("a", "/ignored", "/s", "d", True, True)], "parent string, rel string, prefix string, child string, strip boolean, known boolean")
    assert {x["obj"]: x["route"] for x in fixpoint.mounts(t).collect()} == {"a": "/api", "b": "/api/v1/users", "c": "{}/lost", "d": "/s"}


def test_type_flow(spark):
    s = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = fixpoint.type_flow(s([("x", "y")], "src string, dst string"), s([("x", "A"), ("q", "B")], "node string, type_key string"), s([("s1", "y", "M"), ("s2", "recvA", "N")], "site string, recv string, method_id string"), s([("A", "M", "A.M", "recvA"), ("A", "N", "A.N", "r2"), ("B", "M", "B.M", "r3")], "type_key string, method_id string, decl_fn string, receiver string"))
    assert {tuple(x) for x in got.collect()} == {("s1", "A.M"), ("s2", "A.N")}


def test_string_evaluation(spark):
    rows = [("c1", "const", "/api", []), ("c2", "const", "/users", []), ("cat", "concat", None, ["c1", "c2"]), ("p", "param", None, []), ("pre", "concat", None, ["p", "cat"]), ("fmt", "sprintf", "/a/%s/b", []), ("same", "same", None, ["c1", "c1"]), ("diff", "same", None, ["c1", "c2"]), ("env", "env", "T", []), ("sym", "concat", None, ["env", "c1"]), ("loop", "concat", None, ["loop"]), ("j", "join", None, ["c1", "p"])]
    got = fixpoint.evaluate_strings(spark.createDataFrame(rows, "value string, op string, text string, args array<string>"))
    t = {x["value"]: (x["t"], x["s"]) for x in got.select("value", S.template(F.col("str")).alias("t"), S.symbol(F.col("str")).alias("s")).collect()}
    assert t["cat"][0] == "/api/users" and t["pre"][0] == "{}/api/users" and t["fmt"][0] == "/a/{}/b" and t["same"][0] == "/api"
    assert t["diff"] == ("{}", None) and t["sym"] == ("{}/api", "${env:T}/api") and t["loop"][0] == "{}" and t["j"][0] == "/api/{}"
