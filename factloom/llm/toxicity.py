"""Toxicity by compression distance: windows of a text are compressed with a toxic and an ordinary zstandard dictionary.

Each class's dictionary holds the word beginnings that are typical of it: those whose share of documents differs from the
other class's by many standard errors, shortest first, so that one beginning stands for all the words made from it. Copies in
the sample count once. What is common to both classes is in neither dictionary, so ordinary windows get equally long
either way, and the toxic dictionary shortens those with toxic words. The lengths of a document's windows are compared
at several thresholds, and a logistic curve over the shares of windows beyond them, fitted on rows that the dictionaries
have not seen, calibrates the score.

Learning uses a bounded sample (``SAMPLE``) of the labelled rows that are not held out, taken in the order of a digest of
the id; scoring reads every whole text. The id, source, language and label are never inputs of a score.

Defined results: null text is scored as empty text; without labelled rows of both classes every score is 0.0; repeated rows
are scored alike; labels that are null, and ids labelled with both classes, are not learned from.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, labels, sampled, slices, utf8

#: Most sampled rows of each class.
SAMPLE = {1: 2500, 0: 5000}
#: Words of a window.
WINDOW = 4
#: Standard errors and the ratio of shares that make a beginning typical; entries of a dictionary.
TYPICAL, RATIO, ENTRIES = 5.0, math.e, 300
#: Shortest and longest beginning, with the space before the word.
BEGIN = (5, 14)
#: Saved bytes at which windows are compared.
THRESHOLDS = (1, 2, 3, 4, 5, 7)
#: What both dictionaries end with and every window starts with: its long match outweighs zstandard's rule that small gains stay raw.
LEAD = b"\n#QZ0X9J8K7V6W5Y4U3T2S1R0#\n"
#: Entries of a worker's table of windows already compared; it starts anew when full.
KEPT = 200_000


def _beginnings(text: bytes) -> set[bytes]:
    out = set()
    for w in set(text.lower().split()):
        x = b" " + w
        out.update(x[:k] for k in range(BEGIN[0], min(len(x), BEGIN[1]) + 1))
        out.add(x + b" ")
    return out


def _without_copies(texts: list[bytes]) -> list[bytes]:
    """Texts of which none of the smallest 4-word digests has been seen."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.split()
        least = sorted({zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))})[:8]
        if not seen.intersection(least[:4]):
            seen.update(least)
            out.append(t)
    return out


def _typical(here: Counter, n_here: int, there: Counter, n_there: int) -> list[bytes]:
    found = []
    for s, a in here.items():
        b = there.get(s, 0)
        p = (a + b + 1) / (n_here + n_there + 2)
        z = (a / n_here - b / n_there) / math.sqrt(p * (1 - p) * (1 / n_here + 1 / n_there))
        if a >= 5 and z > TYPICAL and (a + 0.5) / n_here > RATIO * (b + 0.5) / n_there:
            found.append((-z, s))
    out: list[bytes] = []
    for _, s in sorted(found):
        if len(out) < ENTRIES and not any(s in o or o in s for o in out):
            out.append(s)
    return out


def _dictionary(typical: list[bytes]) -> bytes:
    # the most typical come last, where offsets are shortest
    return b"\n".join(typical[::-1]) + LEAD


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress for d in (ordinary, toxic)]
        self.kept: dict[bytes, int] = {}

    def windows(self, text: bytes) -> list[int]:
        words, kept, out = text.lower().split(), self.kept, []
        ordinary, toxic = self.by
        for i in range(0, len(words), WINDOW):
            x = b"%b %b " % (LEAD, b" ".join(words[i : i + WINDOW]))
            d = kept.get(x)
            if d is None:
                if len(kept) >= KEPT:
                    kept.clear()
                d = kept[x] = len(ordinary(x)) - len(toxic(x))
            out.append(d)
        return out

    def features(self, text: bytes) -> list[float]:
        d = np.array(self.windows(text) or [0])
        return [d.mean(), np.clip(d, 0, 9).mean(), *[(d >= k).mean() for k in THRESHOLDS], float(d.max()), math.log1p(len(d))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, weights with the constant first) by Newton's method."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / dev]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w


def learn(docs: DataFrame, marks: DataFrame) -> dict | None:
    """The model from labelled rows that are not held out; None without rows of both classes."""
    spark = docs.sparkSession
    known = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [r for c, n in SAMPLE.items() for r in sampled(known.where(F.col("toxic") == c), n)]
    if len({r.toxic for r in chosen}) < 2:
        return None
    # at most the sample's rows, so it may be broadcast
    picked = F.broadcast(spark.createDataFrame(chosen, known.schema))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    sample = sorted((zlib.crc32(b"order" + str(r.doc_id).encode()), r.toxic, r.text.encode()) for r in rows)
    # two thirds make the dictionaries, the last third calibrates
    made = {c: _without_copies([t for h, k, t in sample if k == c and h % 3]) for c in (0, 1)}
    rest = [(k, t) for h, k, t in sample if not h % 3]
    if not made[0] or not made[1] or len({k for k, _ in rest}) < 2:
        return None
    counts = {c: Counter() for c in made}
    for c, texts in made.items():
        for t in texts:
            counts[c].update(_beginnings(t))
    toxic = _dictionary(_typical(counts[1], len(made[1]), counts[0], len(made[0])))
    ordinary = _dictionary(_typical(counts[0], len(made[0]), counts[1], len(made[1])))
    distance = Distance(toxic, ordinary)
    y = np.array([k for k, _ in rest], float)
    fit = logistic(np.array([distance.features(t) for _, t in rest]), y)
    # the classes were sampled at different rates; the constant goes back to their shares among all labelled rows
    fit[2][0] += math.log(share[1] / share[0]) - math.log(y.sum() / (1 - y).sum())
    return {"toxic": toxic, "ordinary": ordinary, "fit": [a.tolist() for a in fit]}


_distances: dict[tuple[bytes, bytes], Distance] = {}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_saving (bytes, of the most toxic window)."""
    source = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            key = (model["toxic"], model["ordinary"])
            if key not in _distances:
                _distances.clear()
                _distances[key] = Distance(*key)
            distance, (mean, dev, w) = _distances[key], map(np.array, model["fit"])
        for batch in slices(batches, "text", 1 << 23):
            if model:
                x = np.array([distance.features(t or b"") for t in utf8(batch.column("text"))]).reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / dev) @ w[1:], -30, 30)))
                worst = x[:, 2 + len(THRESHOLDS)].astype(int)
            else:
                p, worst = np.zeros(batch.num_rows), np.zeros(batch.num_rows, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32()), pa.array(worst, pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "worst_saving"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_saving int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, labels(spark, sf_dir)))
