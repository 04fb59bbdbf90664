import time

import pyarrow as pa

from factloom.llm import common, quality, tokens


def test_tables_go_when_no_task_of_their_operator_follows(monkeypatch):
    enc = tokens.encoder(tokens.default_model())

    def task(idle):
        monkeypatch.setattr(common, "IDLE", idle)
        with common.tables_kept():
            list(enc.encode_column(pa.array(["plain words and more words", None])))

    task(60)
    assert len(enc.kept) > 0
    # the next task takes over: the first one's timer must not end it
    task(0.2)
    assert len(enc.kept) > 0 and len(enc.fits) > 0
    time.sleep(1)
    assert not enc.kept and not enc.kept.old and not enc.fits and not enc.fits.old


def test_the_sample_is_sent_back_without_python_workers(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality.F, "broadcast", lambda df: sent.append(df) or df)
    marks = spark.createDataFrame([(f"d{k}", k % 2, 0) for k in range(40)] + [(None, 1, 0)], "doc_id string, quality int, toxic int")
    rows = spark.createDataFrame([(f"d{k}", [float(k % 2), float(k)]) for k in range(40)], "doc_id string, x array<double>")
    assert quality.fit(rows, marks) is not None
    (picked,) = sent
    assert "PythonRDD" not in picked._jdf.queryExecution().toRdd().toDebugString()
    want = marks.where(marks.doc_id.isNotNull() & ~common.held_out()).select("doc_id", "quality")
    assert picked.schema == want.schema and sorted(picked.collect()) == sorted(want.collect())
