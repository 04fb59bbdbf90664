import sentencepiece

import corpus_pipeline
from factloom.llm import mixing, quality, tokens

from . import brute
from .test_operators import corpus

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rows = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in corpus(7)] + [(900, "%%% THE!! &&& ***", "en", "s1", 17), (901, None, None, None, None)]
    spark.createDataFrame(rows, DDL).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert good.columns == columns and good.count() == quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("keep").count()
    one = corpus_pipeline.drop_near_copies(spark, good, str(tmp_path))
    texts = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in brute.jaccard(texts).items() if d == c)
    cut = corpus_pipeline.drop_repeats(spark, one, str(tmp_path))
    left = brute.removals([(r.doc_id, r.text) for r in one.collect()])
    for r in cut.collect():
        assert brute.words(r.text) == left[r.doc_id] and (r.text is None or r.n_chars == len(r.text))
    mixed = corpus_pipeline.mix_sources(spark, cut, str(tmp_path))
    want = {r.doc_id: r.copies for r in mixing.mix(cut).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and got == {d: c for d, c in want.items() if c}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    texts = {r.doc_id: r.text or "" for r in cut.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == sum(got.values())
    for r in out:
        assert r.ids == ",".join(map(str, sp.encode(texts[r.doc_id]))) and r.decoded == sp.decode(sp.encode(texts[r.doc_id]))


def test_quality_stage_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum(r.doc_id in kept for r in marks if r.quality) >= 0.99 * sum(r.quality for r in marks)
    assert sum(r.doc_id in kept for r in marks if not r.quality) <= 0.1 * sum(not r.quality for r in marks)
