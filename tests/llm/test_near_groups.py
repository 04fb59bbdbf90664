"""Large groups of near copies, many of which are linked with nothing: neither distances nor components separate them."""

import random

import numpy as np
import pytest

from factloom.llm import jaccard
from factloom.llm.graph import components


def group(n, seed=3, size=120):
    """Sets around a centre, each with a share of its shingles replaced; some have the same replacements, some other sizes."""
    r = random.Random(seed)
    centre, shared = range(size), range(1000, 1000 + size // 3)
    out = {}
    for k in range(n):
        share = r.choice((0.02, 0.05, 0.1, 0.14, 0.16, 0.2, 0.3))
        s = {x if r.random() > share else 10_000 + k * size + x for x in centre}
        s |= set(r.sample(shared, r.choice((0, 0, size // 24, size // 6))))
        s = np.array(sorted(s)[: r.choice((size, size, size, 3 * size // 4))], np.uint64)
        out[s.tobytes()] = s
    return [*out.values()]


def brute(sets):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    plain = [set(s.tolist()) for s in sets]
    for i, a in enumerate(plain):
        for j in range(i):
            common = len(a & plain[j])
            if 4 * common >= 3 * (len(a) + len(plain[j]) - common):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("columns", [None, 8])
def test_regions_have_the_components_of_brute_force(monkeypatch, columns):
    if columns:
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
    for seed, size in ((1, 120), (2, 40), (3, 12)):
        sets = group(300, seed, size)
        region = jaccard._Region(sets)
        region.join(np.arange(len(sets)))
        want = brute(sets)
        assert 1 < len(set(want)) < len(sets)
        assert region.label.tolist() == want


def test_near_copies_are_not_compared_with_all(monkeypatch):
    sets, read = group(1500), []
    common = jaccard._Region.common
    monkeypatch.setattr(jaccard._Region, "common", lambda self, i, part: read.append(len(part[0])) or common(self, i, part))
    region = jaccard._Region(sets)
    region.join(np.arange(len(sets)))
    assert len(np.unique(region.label)) > 100
    assert sum(read) < 100 * sum(map(len, sets))  # over 1,000 times all shingles before


def test_groups_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 4000)
    r = random.Random(5)
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(w if r.random() > share else f"x{k}y{j}" for j, w in enumerate(words)) for k in range(150) for share in [r.choice((0.0, 0.01, 0.03, 0.06))]]
    rows = [(k, t) for k, t in enumerate(texts)]
    sets = [set(tuple(t.split()[j : j + 5]) for j in range(len(words) - 4)) for t in texts]
    number = {}
    want = brute([np.array(sorted(number.setdefault(x, len(number)) for x in s), np.uint64) for s in sets])
    got = {x["doc_id"]: x["component_id"] for x in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1 < len(set(want)) < len(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_edges_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def found(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(2000).selectExpr("cast(id as string) a", "cast(id - id % 5 as string) b").repartition(4).mapInArrow(found, "a string, b string")
    got = {r.node: r.component for r in components(edges).collect()}
    assert seen.value == 2000
    groups = [sorted(map(str, range(k, k + 5))) for k in range(0, 2000, 5)]
    assert got == {x: g[0] for g in groups for x in g[1:]}
