import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embeddings, jaccard, licenses, media, mixing, quality, sharding, substrings, tokens, toxicity
from factloom.llm.common import written
from factloom.llm.graph import components

from . import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
# what every operator meets: nulls, empty and blank texts, short ones, repeated rows, a long one
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "x " * 30_000, "en", "b", 60_000), (None, "no id here at all", "en", "a", 17), (7, "É   wörd  \x1c x", None, "a", 10)]


def docs(spark, rows, ddl=DOC):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # columns that clash with the operators' own names ride along
    return docs(spark, ODD).withColumn("size", F.lit("s")).withColumn("class", F.lit("c")).withColumn("position", F.lit(1))


OPERATORS = {
    "mix": lambda d: mixing.mix(d), "order": lambda d: mixing.in_training_order(d), "media": lambda d: media.read(media.store(d)), "tokens": lambda d: tokens.encode(d), "jaccard": lambda d: jaccard.cluster(d), "one": lambda d: jaccard.one_of_each(d),
    "substrings": lambda d: substrings.removals(d), "without": lambda d: substrings.without_repeats(d), "licenses": lambda d: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name not in ("order", "one"):
        assert len(rows) == len(ODD)
    if name in ("order", "one", "without"):
        assert set(odd.columns) == set(rows[0].asDict())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_labelled_operators_on_odd_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marks = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for m in (none, marks):
        assert quality.classify(odd, m).count() == len(ODD) and toxicity.score(odd, toxicity.learn(odd, m)).count() == len(ODD)
        assert quality.classify(odd.limit(0), m).count() == 0 and toxicity.score(odd.limit(0), toxicity.learn(odd.limit(0), m)).count() == 0
    assert quality.kept(odd, none).columns == odd.columns and quality.kept(odd, none).count() == len(ODD)
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(odd, none)).collect()} == {0.0}


def test_mix(spark, real):
    rows = [(r.doc_id, r.source, r.text) for r in real.collect()] + [(10_000, None, "a b c"), (10_001, "src0", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size, target = brute.mix(rows)
    taken, most = dict.fromkeys(size, 0), 0
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=str)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.copies * r.size == len(r.positions) * r.size
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
        most = max(most, r.size)
    assert all(abs(taken[s] - target[s]) <= most for s in size)
    ordered = mixing.in_training_order(d)
    assert ordered.count() == sum(r.copies for r in got) and ordered.columns == d.columns


def test_schedules_are_inverted(spark):
    for k, knots in enumerate(mixing.CURRICULUM):
        shares = [i / 50 for i in range(51)]
        df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.when_asked(F.col("s"), F.lit(k)).alias("t"))
        (t0, w0), (t1, w1) = knots
        for r in df.collect():
            area = w0 * r.t + (w1 - w0) * r.t * r.t / 2
            assert abs(area / ((w0 + w1) / 2) - r.s) < 1e-9


def test_media_round_trip(spark, odd):
    rows = {(r.doc_id, r.n_bytes): r for r in media.read(media.store(odd)).collect()}
    for doc_id, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[doc_id, len(raw)]
        assert r.payload_bytes == len(payload) and r.payload_sha256 == __import__("hashlib").sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert len(r.rgb) == r.width * r.height * 3
    assert rows[4, 7].media_sha256 == rows[5, 7].media_sha256 and rows[4, 7].feature == rows[5, 7].feature


def test_media_scans_any_way(monkeypatch):
    rng = random.Random(3)
    for n in (1, 64, 400, 3000):
        data = media.padded(rng.randbytes(n))
        image = media._Image(media.encode_group([data])[0])
        fast = media.decode_group([image])
        with monkeypatch.context() as m:
            m.setattr(media, "_even_scan", lambda *a: False)
            slow = media.decode_group([image])
        assert all((fast[c] == slow[c]).all() for c in fast)
        assert media.payload_of(image, fast)[0].tobytes()[: image.payload_bytes] == data
        both = media.encode_group([data, bytes(len(data))])
        assert both[0] == media.encode_group([data])[0]


def test_general_progressive_scans():
    """A file with runs, end-of-band runs, refinements that make new coefficients, and restart markers, written by hand."""
    bits = lambda s: int(s.ljust(-(-len(s) // 8) * 8, "1"), 2).to_bytes(-(-len(s) // 8), "big").replace(b"\xff", b"\xff\x00")
    table = lambda kind, symbols: media._segment(0xC4, bytes([kind << 4, 0, 0, len(symbols), *[0] * 13, *symbols]))  # noqa: E731  codes of three bits
    scan = lambda a, b, h, lo, s: media._segment(0xDA, bytes([1, 1, 0, a, b, h << 4 | lo])) + s
    import struct

    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([1]) * 64) + media._segment(0xC2, struct.pack(">BHHB", 8, 8, 24, 1) + bytes([1, 0x11, 0]))
    dc = table(0, [0, 1, 2, 3])
    ac = table(1, [0x00, 0x10, 0x11, 0x02, 0x01, 0xF0])
    # DC: +2, -1, 0 as differences of sizes 2, 1, 0, shifted by one
    first = scan(0, 0, 0, 1, bits("010" + "10" + "001" + "0" + "000"))
    # AC first, low 1: block 0: run 1 size 1 (+1), then end of band; then blocks 1 and 2 in a run of two
    band = scan(1, 5, 0, 1, bits("010" + "1" + "001" + "1"))
    # refinement: block 0: new -1 at place 1 (symbol run 0 size 1, sign 0), then end of band with a correction of place 2; blocks 1, 2 in an end-of-band run of two
    more = scan(1, 5, 1, 0, bits("100" + "0" + "000" + "1" + "001" + "0"))
    image = media._Image(head + dc + ac + first + band + more + b"\xff\xd9")
    c = media.decode_group([image])[1][0]
    assert c[:, 0].tolist() == [4, 2, 2]
    assert c[0, 1:6].tolist() == [-1, 3, 0, 0, 0]
    assert media.pixels_of(image, {1: c[None]} | {}) is not None if len(image.components) == 3 else True


def test_inverse_transform():
    c = np.zeros((1, 64))
    c[0, 0] = 80
    assert np.allclose(c @ media.INVERSE / 2**20, 10, atol=1e-4)


def test_tokens_equal_the_library(spark, real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    enc = tokens.encoder(tokens.default_model())
    rng = random.Random(1)
    texts = [r.text for r in real.collect()] + [t or "" for _, t, *_ in ODD]
    pieces = list(enc.ids)
    alphabet = "aab  \n\t▁étheinonrs日<0x>😀\x00ABC12.,-_/　ﬁ"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))).replace("▁", " ") for _ in range(3000)]
    for t in texts:
        ids = sp.encode(t)
        mine = enc.encode(t)
        assert mine == ",".join(map(str, ids)) and enc.decode(mine) == sp.decode(ids)
    for _ in range(300):
        ids = [rng.randrange(3, 32_000) for _ in range(4)]
        assert enc.decode(",".join(map(str, ids))) == sp.decode(ids)
    row = tokens.encode(real).orderBy("doc_id").first()
    first = min(real.collect(), key=lambda r: r.doc_id)
    assert row.n_tokens == len(sp.encode(first.text)) and row.decoded_sha256 == brute.sha(sp.decode(sp.encode(first.text)))


def corpus(seed, n=120):
    """Copies, near copies, shared passages and runs over a small vocabulary."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 150))] for _ in range(12)]
    out = []
    for k in range(n):
        kind = r.random()
        w = list(r.choice(base))
        if kind < 0.3:
            for _ in range(max(1, len(w) // r.choice([8, 20, 60]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind < 0.5:
            w = [r.choice(vocabulary) for _ in range(r.randint(10, 80))]
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(10) :]
        elif kind < 0.6:
            w = [x for x in r.choices(vocabulary[:3], k=5) for _ in range(r.randint(1, 20))]
        elif kind < 0.7:
            w = w[: r.randint(0, len(w))]
        out.append((k, " ".join(x.upper() if r.random() < 0.02 else x for x in w)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed):
    # small bounds, so that mappers send often; regions beyond a task's size in the second seed
    monkeypatch.setattr(jaccard, "PACKED", 300)
    monkeypatch.setattr(jaccard, "REGION", {1: 4_000_000, 2: 150, 3: 400}[seed])
    rows = corpus(seed)
    want = brute.jaccard(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(12))
def test_regions_are_joined_exactly(monkeypatch, seed):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    base = [r.choice(2000, r.integers(3, 60), replace=False) for _ in range(6)]
    sets = []
    for _ in range(120):
        s = set(base[r.integers(6)].tolist())
        for _ in range(r.integers(0, 12)):
            if len(s) > 1 and r.random() < 0.5:
                s.discard(r.choice(sorted(s)))
            else:
                s.add(int(r.integers(2000)))
        sets.append(s)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    region = jaccard._Region([np.array(sorted(s), np.uint64) for s in sets])
    region.join(np.arange(len(sets)))
    assert dict(enumerate(region.label.tolist())) == brute.components(range(len(sets)), links)


def test_one_of_each_with_repeated_ids(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (3, " "), (3, " ")]
    kept = jaccard.one_of_each(spark.createDataFrame([(*x, k, "own") for k, x in enumerate(rows)], "doc_id long, text string, k int, __hash string"))
    assert sorted((str(r.doc_id), str(r.text), r["__hash"]) for r in kept.collect()) == sorted([("1", rows[0][1], "own"), ("1", rows[1][1], "own"), ("None", rows[0][1], "own"), ("None", "None", "own"), ("3", " ", "own"), ("3", " ", "own")])


def test_one_of_each(spark):
    rows = corpus(4) + [(500, None), (501, "")]
    want = brute.jaccard(rows)
    kept = sorted(r.doc_id for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(d for d, (_, c) in want.items() if d == c)


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "CHUNK", 4000)
    rows = corpus(seed)
    want = brute.removals(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for r in substrings.removals(d).collect():
        n = len(brute.words(dict(rows)[r.doc_id]))
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(want[r.doc_id]), brute.sha(" ".join(want[r.doc_id])))
    for r in substrings.without_repeats(d).collect():
        old = dict(rows)[r.doc_id]
        assert r.text == (old if len(want[r.doc_id]) == len(brute.words(old)) else " ".join(want[r.doc_id]))


def test_window_keys_hang_on_the_window_alone():
    rng = np.random.default_rng(0)
    for t in range(400):
        base = rng.integers(0, rng.integers(1, 8), rng.integers(13, 200))
        if t % 3 == 0:
            part = rng.integers(0, 6, rng.integers(13, 40))
            base = np.concatenate([rng.integers(0, 4, rng.integers(0, 9)), part, rng.integers(0, 4, rng.integers(0, 9)), part, rng.integers(0, 4, 5)])
        if t % 5 == 0:
            base = np.repeat(base, rng.integers(1, 20, len(base)))[:300]
        h = substrings.mixed(base.astype(np.uint64) + np.uint64(77))
        starts = np.arange(len(h) - 12)
        digests = substrings.window_digests(h)
        keys = substrings.window_keys(h, starts, digests)
        seen = {}
        for i in starts:
            assert seen.setdefault(tuple(base[i : i + 13]), (keys[i], digests[i])) == (keys[i], digests[i])
        assert len({d for _, d in seen.values()}) == len(seen)


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = np.where(rng.random((n, 1)) < 0.5, centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.12, rng.normal(size=(n, dim)))
    x[5:9] = x[4]
    return x.astype(np.float32)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    x = vectors(1)
    rows = [(k, [float(v) for v in u], 0) for k, u in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [1.0], 0), (None, [1.0] * 16, 0), (3, [float(v) for v in x[3]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = embeddings.link(df).collect()
    assert len(got) == len(rows)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = near.sum(axis=1) - 1 + near[:, 3]
    by = {r.vec_id: r for r in got}
    found = np.array([by[k].n_links for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b]
    comp = brute.components(range(len(x)), links)
    assert np.mean([by[k].component_id == comp[k] for k in range(len(x))]) > 0.95
    for k in (1000, 1001, 1002, 1003, 1004):
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True)
    assert (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, False)
    assert embeddings.link(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d, m = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marks = m.where("toxic IS NOT NULL")
    scored = toxicity.score(d.join(marks.select("doc_id"), "doc_id", "left_semi"), toxicity.learn(d, m)).join(marks, "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in scored]), np.array([r.toxic for r in scored])
    auc = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert auc > 0.7 and ((s >= 0.5) & (y == 0)).mean() < 0.03 and set((s >= 0.5).astype(int)) == {r.predicted for r in scored}


def test_quality_on_held_out_rows(spark):
    d, m = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, m).join(m, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.97
    assert all(0 < r.p_host < 1 and 0 < r.p_path < 1 for r in got)


def test_sites_shrink_towards_their_priors(spark):
    rows = [("good", "a", 0.9)] * 60 + [("bad", "a", 0.1)] * 60 + [("bad", "b", 0.1)] * 2 + [("new", "x", 0.1)] + [(None, None, 0.5)] * 3
    sites = quality.Sites(spark.createDataFrame(rows, "host string, path string, p double"))
    judged = sites.judged(spark.createDataFrame(rows, "host string, path string, p double"), "host", "path", "p").collect()
    by = {(r.host, r.path): r for r in judged}
    assert by["good", "a"]["__path_posterior"] > 0.8 > 0.3 > by["bad", "a"]["__path_posterior"]
    # a site of one document says nothing about it but the prior
    assert abs(by["new", "x"]["__path_posterior"] - sites.overall) < 0.02 and len(judged) == len(rows)


def test_sharding(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=60_000, fan_in=4, smallest=4_000)
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__x", F.lit(None).cast("string"))
    store.append(d.repartition(3), arrivals=4)
    state = store.manifest()
    assert state["version"] == len(store.versions()) and store.read().exceptAll(d).isEmpty() and d.exceptAll(store.read()).isEmpty()
    small = [s for s in state["shards"] if s["bytes"] < 45_000]
    assert max((sum(s["tier"] == t for s in small) for t in {s["tier"] for s in small}), default=0) < 4
    store.append(d.limit(5).coalesce(1), compact=False)
    assert store.read().count() == d.count() + 5
    assert store.read(state["version"]).count() == d.count()
    other = sharding.Store(spark, f"file://{tmp_path}/s")
    before = other.manifest()
    store._commit(before, before["shards"], before["schema"])
    with pytest.raises(RuntimeError):
        other._commit(before, before["shards"], before["schema"])
    with pytest.raises(ValueError):
        store.append(d.select("doc_id"))
    files = {f"data/{p.parent.parent.name}/{p.parent.name}" for p in tmp_path.rglob("part-*.parquet")}
    assert files and json.loads((tmp_path / "s" / "manifests" / f"v{len(store.versions()):08d}.json").read_text())["version"] == len(store.versions())
    empty = sharding.Store(spark, f"file://{tmp_path}/e")
    empty.append(d.limit(0), arrivals=2)
    assert empty.read().count() == 0


def test_licenses_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(50)] + ["the", "license,", "under", "licensed"]
    rows = []
    for k in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if k % 2:
            t = list(r.choice(list(licenses.TEMPLATES.values())).split())
            if k % 4 == 3:
                t[r.randrange(len(t))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if k % 8 == 1 else x for x in t]
        rows.append((k, " ".join(w)))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    got = {x.doc_id: {m.split("@")[0] for m in x.matches.split(";") if m} for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        s = licenses.shingles(licenses._words([text.encode()]).hashes, 5)
        for group in scanner.groups:
            for name, own in group.templates:
                # at any place
                best = max((np.isin(own, s[a : a + group.window - 4]).mean() for a in range(len(s))), default=0)
                assert (name in got[k]) == (best >= 0.75), (k, name)


def test_written_tables_are_shared(spark):
    df = written(spark.range(5))
    assert df.count() == 5 and "factloom-" in df.inputFiles()[0]
