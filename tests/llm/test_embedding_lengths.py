"""Vectors of several lengths: each length is linked by itself, wherever its rows sit."""

import random

from factloom.llm import embeddings


def test_lengths_in_one_batch(spark):
    r = random.Random(3)
    rows = []
    for k in range(12):
        n = 8 if k % 3 else 5
        v = [r.gauss(0, 1) for _ in range(n)]
        rows += [(2 * k, v), (2 * k + 1, [x * 1.0 + 1e-3 for x in v])]
    # a length that no other row has, and rows without a usable vector
    rows += [(100, [1.0, 2.0]), (101, None), (102, [0.0] * 5)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()}
    assert got == {**{k: (1, k - k % 2) for k in range(24)}, 100: (0, 100), 101: (0, 101), 102: (0, 102)}


def test_large_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [2e-200, 2e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [float("inf"), 1.0])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{k: (3, 1) for k in (1, 2, 3, 4)}, 5: (0, 5), 6: (0, 6)}


def test_partitions_make_no_difference(spark):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    rows = [(k, [x + r.gauss(0, 0.1) for x in base[r.randrange(10)]][: r.choice([12, 12, 7])]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(tuple(x) for x in embeddings.link(d).collect()) for d in (df.coalesce(1), df.repartition(9)))
    assert one == many


def test_recall_near_the_threshold(spark):
    # pairs whose cosines lie just above the threshold, among vectors that share nothing
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, 600, 2):
        side = rng.normal(size=32)
        side -= side @ x[k] * x[k]
        c = rng.uniform(0.9501, 0.97)
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    got = embeddings.link(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[k] <= w for k, w in enumerate(want)) and sum(found.values()) >= 0.9 * want.sum() > 0, (sum(found.values()), want.sum())
