"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over counts of characters, words and lines gives each document a probability. Hosts and paths collect
their documents' probabilities: a host's posterior shrinks its mean towards that of all documents, and a path's towards its
host's, each by a strength that the method of moments finds from how much the groups differ. So sparse sites stay near the
prior. A document is judged by its own evidence and by its site's posterior without it:

    logit(posterior) = logit(p) + logit(path without this document) - logit(all documents)

The classifier is fitted on at most ``SAMPLE`` labelled rows that are not held out; group statistics cover all documents.
Features, scores and joins are DataFrame expressions. In ``documents`` the source stands for the host and the language for the path.

Defined results: null text is judged as empty text; null hosts form one host and null paths one path of their host; without
labels of both classes the classifier says 0.5 and everything is kept; ids labelled with both classes are not learned from; repeated
rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, labels, local_table, sampled, written
from .mixing import word_count
from .toxicity import logistic

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
#: Posterior from which a document is kept.
KEEP = 0.5
#: A group's prior counts for at most this many documents.
STRONGEST = 1e4


def features(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    n = (F.char_length(t) + 1).cast("double")
    words = (word_count(t) + 1).cast("double")
    lines = (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("double")

    def left(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(t, pattern, "")).cast("double")

    def of(mark: str) -> Column:
        return (F.char_length(t) - F.char_length(F.replace(t, F.lit(mark), F.lit("")))).cast("double")

    upper, symbols, digits = left(r"\P{Lu}+") / n, left(r"[^%*&$#|!~^=_<>+@]+") / n, left(r"[^0-9]+") / n
    distinct = F.size(F.array_distinct(F.split(t, r"[ \n]+"))) / words
    return [
        F.ln(n), F.ln(words), distinct, distinct * distinct, upper, F.least(upper * 10, F.lit(1.0)), symbols, F.least(symbols * 10, F.lit(1.0)), digits,
        lines / n, of(".") / words, of(",") / words, of("|") / words, of("!") / words, n / words / 10,
        F.size(F.array_distinct(F.split(t, "\n"))) / lines,
    ]


def fit(rows: DataFrame, marks: DataFrame) -> list[np.ndarray] | None:
    """``rows`` has doc_id and the array x; ``marks`` doc_id and quality."""
    known = marks.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    chosen = sampled(known.join(rows.select("doc_id"), "doc_id", "left_semi"), SAMPLE)
    if not chosen:
        return None
    # at most the sample's rows, so it may be broadcast; rows with an id in common count once
    picked = F.broadcast(local_table(rows.sparkSession, chosen, known.schema))
    sample = rows.select("doc_id", "x").join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    sample.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in sample], float)
    return None if len(set(y)) < 2 else list(logistic(np.array([r.x for r in sample], float), y))


def _dot(x: Column, model: list[np.ndarray] | None) -> Column:
    if model is None:
        return F.lit(0.0)
    mean, dev, w = model
    z = F.lit(float(w[0] - ((mean / dev) * w[1:]).sum()))
    for i, c in enumerate(w[1:] / dev):
        z = z + F.get(x, F.lit(i)) * F.lit(float(c))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))


def probability(x: Column, model: list[np.ndarray] | None) -> Column:
    return 1 / (1 + F.exp(-_dot(x, model)))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, overall: float) -> float:
    """Documents that the prior counts for, by the method of moments: spread between groups beyond what their sizes explain."""
    r = groups.where("n > 0").agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    if not r["groups"] or r["groups"] < 2:
        return STRONGEST
    within = max(r["within"], 0.0) / max(1, r["n"] - r["groups"])
    spread = (r["between"] - (r["groups"] - 1) * within) / r["n"]
    return STRONGEST if spread <= 0 else float(min(STRONGEST, max(1.0, overall * (1 - overall) / spread - 1)))


class Sites:
    """Sums of hosts and paths with the priors' strengths, from rows of host, path and p."""

    def __init__(self, rows: DataFrame):
        sums = [F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
        paths = written(rows.groupBy("host", "path").agg(*sums), "paths")
        hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        self.overall = total["s"] / total["n"] if total["n"] else 0.5
        self.host_strength = _strength(hosts, F.lit(self.overall), self.overall)
        h = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
        both = paths.join(h, F.col("host").eqNullSafe(F.col("h")))
        self.path_strength = _strength(both, F.col("host_s") / F.col("host_n"), self.overall)
        # one row for each host and path
        self.table = written(both.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("host_n").alias("__host_n"), F.col("host_s").alias("__host_s")), "sites")

    def judged(self, rows: DataFrame, host: str, path: str, p: str) -> DataFrame:
        """``rows`` with __host_posterior, __path_posterior (both without the row itself) and __posterior."""
        joined = rows.join(self.table, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")))
        h = (self.host_strength * self.overall + F.col("__host_s") - F.col(p)) / (self.host_strength + F.col("__host_n") - 1)
        joined = joined.withColumn("__host_posterior", h)
        q = (self.path_strength * F.col("__host_posterior") + F.col("__s") - F.col(p)) / (self.path_strength + F.col("__n") - 1)
        joined = joined.withColumn("__path_posterior", q)
        z = _logit(F.col(p)) + _logit(F.col("__path_posterior")) - _logit(F.lit(self.overall))
        return joined.withColumn("__posterior", 1 / (1 + F.exp(-z))).drop("__host", "__path", "__n", "__s", "__host_n", "__host_s")


def learn(docs: DataFrame, marks: DataFrame, host: str = "source", path: str = "lang") -> tuple[DataFrame, list | None, Sites]:
    """(rows with doc_id, host, path and p; the classifier; the sites)."""
    rows = written(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.array(*features(F.col("text"))).alias("x")), "features")
    model = fit(rows, marks)
    scored = rows.select("doc_id", "host", "path", probability(F.col("x"), model).alias("p"))
    return scored, model, Sites(scored)


def classify(docs: DataFrame, marks: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row per document: doc_id, host, path, p_document, p_host, p_path, p_quality, keep."""
    scored, _, sites = learn(docs, marks, host, path)
    judged = sites.judged(scored, "host", "path", "p")
    return judged.select("doc_id", "host", "path", F.col("p").alias("p_document"), F.col("__host_posterior").alias("p_host"), F.col("__path_posterior").alias("p_path"), F.col("__posterior").alias("p_quality"), (F.col("__posterior") >= KEEP).alias("keep"))


def kept(docs: DataFrame, marks: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    _, model, sites = learn(docs, marks, host, path)
    # the columns travel in a struct, so no name of theirs meets one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), probability(F.array(*features(F.col("text"))), model).alias("p"), F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("q"))
    return sites.judged(rows, "h", "q", "p").where(F.col("__posterior") >= KEEP).select("row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))
