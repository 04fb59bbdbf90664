"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

Every source has a weight schedule over training time 0..1. Its integral says which share of the source's words training
has asked for by any time, so the inverse of that integral turns a document's place among its source's words into a
training position; documents are then range-sorted by position.

A source's words are accumulated over documents in the order of md5(doc_id). The running sum is taken in two steps, over
buckets of the digest and inside each bucket, so that no task holds more than a bucket of a source, however large.

Defined results: null text counts as no words; null sources form one source, ordered last; rows that repeat are mixed one
by one; a null doc_id is hashed as the empty string; an empty table gives an empty one. Columns besides doc_id, text and
source are carried or dropped untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Knots (time, weight) of the schedules of the sources in order, repeating; linear between knots.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
#: Share of all words that the mix takes, and the most times that a source may be taken.
SHARE, REPEATS = 1.5, 2
#: Leading hex digits of the digest that make a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, size) rows -> one row per source with rank, source_size and target.

    Resharing the excess over the caps by weight until nothing is above a cap ends at the level L with
    sum(min(cap, L * weight)) = share * words, found here with running sums over the sources by cap / weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = total.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    capped = ordered.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    level = capped.select(
        "*",
        F.row_number().over(by_level).alias("at"),
        (
            (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    return level.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("at"))).over(every)).select(
        "source", "rank", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start time, weight there, slope, share asked before it, share asked by its end) of each segment."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, []
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        out.append((a[0], a[1] / whole, (b[1] - a[1]) / (b[0] - a[0]) / whole, done, done + area / whole))
        done += area / whole
    return out


def when_asked(share: Column, rank: Column, curriculum: Sequence = CURRICULUM) -> Column:
    """The time by which a source's schedule has asked for ``share`` of what it asks in all."""
    choice = None
    for i, knots in enumerate(curriculum):
        time = None
        for t, w, slope, s, end in reversed(_segments(knots)):
            ahead = share - F.lit(s)
            root = F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * ahead))
            here = F.lit(t) + F.when(root > 0, F.lit(2.0) * ahead / root).otherwise(0.0)
            time = here if time is None else F.when(share <= end, here).otherwise(time)
        choice = F.when(rank % len(curriculum) == i, time) if choice is None else choice.when(rank % len(curriculum) == i, time)
    return choice


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, curriculum: Sequence = CURRICULUM, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions (one per copy)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest")), "sizes")
    sizes = sizes.withColumn("bucket", F.substring("digest", 1, bucket_digits))
    targets = source_targets(sizes.select("source", "size"), weights, share, repeats)
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    t, b, s = targets.alias("t"), buckets.alias("b"), sizes.alias("s")
    starts = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.rank", "t.source_size", "t.target").alias("b")
    placed = s.join(starts, F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.bucket") == F.col("b.bucket"))).select("s.*", "b.bucket_start", "b.rank", "b.source_size", "b.target")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / F.lit(2.0)
    placed = placed.withColumn("place", place)
    # a copy belongs to the mix if the middle of its words is within the target
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("place") + e * F.col("source_size")), lambda x: x <= F.col("target"))
    placed = placed.withColumn("places", places).withColumn("copies", F.size("places"))
    asked = F.transform("places", lambda x: when_asked(F.when(F.col("target") > 0, x / F.col("target")).otherwise(0.0), F.col("rank"), curriculum))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), asked.alias("positions"))


def in_training_order(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    Rows that the mix can't tell apart (of one id, source and size) are numbered on both sides, so each takes the copies of one of them.
    """
    same = lambda size: F.to_json(F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), size.alias("n")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(same(word_count(F.col("text"))).alias("same"), F.xxhash64("text").alias("hash"), row.alias("row"), F.lit(None).cast("array<double>").alias("positions"))
    plan = mix(docs, **how).select(same(F.col("size")).alias("same"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "positions")
    # both sides in one exchange by what tells rows apart, so that texts are shuffled once before the sort
    dealt = rows.unionByName(plan).repartition("same").withColumn("planned", F.col("positions").isNotNull())
    order = Window.partitionBy("same", "planned").orderBy("hash", F.desc(F.size("positions")), "positions")
    paired = dealt.withColumn("number", F.row_number().over(order)).groupBy("same", "number").agg(F.first("row", ignorenulls=True).alias("row"), F.first("positions", ignorenulls=True).alias("positions"))
    return paired.where(F.size("positions") > 0).select("row", F.explode("positions").alias("position")).orderBy("position", "row.doc_id").select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source
), capped AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS cap FROM total
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS pos,
    ((SELECT sum(source_size)::DOUBLE FROM total) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM capped
), found AS (SELECT arg_min(lam, pos) AS lam FROM levels WHERE lam * weight <= cap),
targets AS (SELECT source, rank, source_size, least(cap, found.lam * weight) AS target FROM capped, found),
placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + s.size / 2.0::DOUBLE AS place
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), share AS (
  SELECT *, CASE WHEN place <= target THEN CASE WHEN target > 0 THEN place / target ELSE 0 END END AS x FROM placed
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN place <= target THEN size ELSE 0 END + CASE WHEN place + source_size <= target THEN size ELSE 0 END)::BIGINT AS taken,
  round(CASE rank % 3 WHEN 0 THEN 2.0::DOUBLE * x / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * x)))
    WHEN 1 THEN 2.0::DOUBLE * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * x)) ELSE x END, 9) AS position
FROM share
"""
