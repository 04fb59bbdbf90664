"""Odd rows: clashing names, repeated rows, versions that stay readable, long texts and labels of both classes."""

import pytest

from factloom.llm import mixing, quality, sharding, toxicity


def test_repeated_rows_keep_the_totals_of_the_mix(spark):
    rows = [(k // 2, f"{'w ' * (k // 2 % 7 + 1)}{k % 2}", "ab"[k % 3 > 0], k) for k in range(40)] + [(None, "same text", "a", k) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __position int")
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    out = mixing.in_training_order(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        assert (r.doc_id, r.text, r.source, r["__position"]) in rows
    assert words == {k: v for k, v in taken.items() if v}


def test_kept_rows_keep_clashing_columns(spark):
    rows = [(1, "Plain words make a good sentence here.", "s", "en", 0.25, "x", "y"), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __p double, __path string, __host string")
    out = quality.kept(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == rows


def test_versions_stay_readable(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", fan_in=3, smallest=1 << 10, keep=3)
    counts = {}
    for k in range(6):
        state = store.append(spark.range(k * 100, k * 100 + 100).withColumnRenamed("id", "__arrival"), arrivals=2, compact=True)
        counts[state["version"]] = 100 * (k + 1)
        for v in store.versions():
            rows = store.read(v).count()
            assert rows == counts.get(v, rows) and rows <= 100 * (k + 1)
    assert len(store.versions()) == 3
    with pytest.raises(ValueError):
        store.read(1)
    # every file that is left belongs to a version that is left
    named = {s["name"] for v in store.versions() for s in store.manifest(v)["shards"]}
    there = {str(p.relative_to(tmp_path / "s")) for p in tmp_path.rglob("part-*.parquet")}
    assert named == there


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (sharding.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    state = a.append(spark.range(5))
    a._commit(state, state["shards"], state["schema"])
    with pytest.raises(RuntimeError):
        b._commit(state, state["shards"], state["schema"])
    assert b.read().count() == 5


def test_long_texts_and_contradicting_labels_in_learning(spark):
    rows = [(k, ("calm weather over the harbour " * 4000 if k == 2 else "calm weather over the harbour again ") if k % 2 else f"vilestword hatefulness number {k} " * 3) for k in range(200)]
    marks = [(k, 1 - k % 2) for k in range(200)] + [(1, 1), (3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(out) == 200 and all(0 <= r.score <= 1 for r in out)


def test_posteriors_equal_brute_force(spark):
    rows = [(k, f"h{k % 3}" if k % 7 else None, f"p{k % 4}", (k * 37 % 100) / 100) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    sites = quality.Sites(df)
    overall = sum(r[3] for r in rows) / len(rows)
    assert abs(sites.overall - overall) < 1e-12
    for r in sites.judged(df, "host", "path", "p").collect():
        others = [x for x in rows if x[0] != r.doc_id and x[1] == r.host]
        host = (sites.host_strength * overall + sum(x[3] for x in others)) / (sites.host_strength + len(others))
        here = [x for x in others if x[2] == r.path]
        path = (sites.path_strength * host + sum(x[3] for x in here)) / (sites.path_strength + len(here))
        odds = r.p / (1 - r.p) * path / (1 - path) / (overall / (1 - overall)) if 0 < r.p < 1 else None
        assert abs(r["__path_posterior"] - path) < 1e-9
        assert odds is None or abs(r["__posterior"] - odds / (1 + odds)) < 1e-9


def test_sharding_query_names_each_document_once(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    got = sharding.op5_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == want and all(r.shard_bytes > 0 and r.tier >= 0 for r in got) and len({r.version for r in got}) == 1
