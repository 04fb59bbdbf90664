"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of vectors serves as reference points (pivots). Each vector is described by its ``NEAREST`` nearest pivots in
order, and entered in the inverted lists of the first ``LISTED`` of them. Two vectors of a list are retrieved if they have ``SHARED``
of their nearest pivots in common, counted by a product of indicator rows; a pair that meets in several lists is taken in that of the
least pivot alone, so link counts are sums over lists. Retrieved pairs are verified by their cosine in
double precision, a block of a list against a block of it at a time, so a long list is many tasks of a bounded size and no
pair ever leaves its task: a task returns each vector's links and the least vector it is connected to.

Equal vectors are one entry with a weight. The number of pivots grows with the square root of the vectors up to
``MOST_PIVOTS`` or ``MOST_BYTES``, which bounds what travels with the code; beyond that lists grow with the vectors, none is cut. Each
length of vectors has pivots of its own. The index is approximate: pairs that share too few pivots are missed; tests measure the recall.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing, and vectors link with
those of their length alone; rows without vec_id link with nothing and have no component; rows with equal ids and vectors are entries of
their own; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, least_connected

COSINE = 0.95
#: Pivots: multiples of the root of the number of vectors, with bounds.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, MOST_BYTES = 8, 64, 65_536, 64 << 20
#: Pivots in a vector's permutation; lists that it is entered in; pivots that two permutations must have in common.
NEAREST, LISTED, SHARED = 8, 5, 3
#: Pivots have a cosine below this with each other.
APART = 0.8
#: Vectors in a block of a list.
BLOCK = 1024


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the rows with a usable vector, for each length of vectors."""
    by_length: dict[int, list[tuple[int, list]]] = {}
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            by_length.setdefault(len(v), []).append((k, v))
    for n in sorted(by_length):
        at = np.array([k for k, _ in by_length[n]])
        x = np.array([v for _, v in by_length[n]], float)
        largest = np.abs(x).max(axis=1)
        ok = np.isfinite(largest) & (largest > 0)
        if ok.any():
            # by the largest component first, so that no square overflows or vanishes; a subnormal one is raised by a power of two
            x = np.ldexp(x[ok], -np.frexp(largest[ok])[1][:, None])
            yield at[ok], x / np.linalg.norm(x, axis=1)[:, None]


def _entries(vectors: DataFrame) -> DataFrame:
    """vec_id, digest (null: links with nothing)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[str | None] = [None] * batch.num_rows
            raw = batch.column("embedding").to_pylist()
            for k in (k for at, _ in _matrices(batch.column("embedding")) for k in at):
                digests[k] = hashlib.blake2b((np.array(raw[k], float) + 0.0).tobytes(), digest_size=16).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.string())], ["vec_id", "digest"])

    return vectors.mapInArrow(run, f"vec_id {kind}, digest string")


def _apart(x: np.ndarray) -> np.ndarray:
    """Of the sample, in order, those not close to one taken before: a tight cluster keeps one pivot, which all of it is nearest to."""
    taken = x[:1]
    for s in range(1, len(x), 256):
        for u in x[s : s + 256][((x[s : s + 256] @ taken.T) < APART).all(axis=1)]:
            if ((taken[-256:] @ u) < APART).all():
                taken = np.vstack([taken, u])
    return taken


def _lists(distinct: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], nearest: int) -> DataFrame:
    """pivot, rep, weight, pivots (nearest first), unit vector; a row for each list that a vector is entered in.

    ``pivots`` has for each length of vectors the number of the first of its pivots, and the pivots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                for at, x in _matrices(batch.column("embedding")):
                    first, of_length = pivots[x.shape[1]]
                    near = x @ of_length.T
                    k = min(nearest, len(of_length))
                    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1) + first
                    lists = min(LISTED, k)
                    rep, weight = (np.array(batch.column(c).to_pylist())[at] for c in ("rep", "weight"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(order[:, :lists].ravel(), pa.int32()), pa.array(rep.repeat(lists), pa.int64()), pa.array(weight.repeat(lists), pa.int64()), pa.array([p for o in order.astype(np.int32) for p in [o.tobytes()] * lists], pa.binary()), pa.array([v for u in x for v in [u.tobytes()] * lists], pa.binary())],
                        ["pivot", "rep", "weight", "pivots", "unit"],
                    )

    return distinct.mapInArrow(run, "pivot int, rep long, weight long, pivots binary, unit binary")


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        rep, weight, block = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "weight", "block"))
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), float).reshape(len(rep), -1)
        own = np.frombuffer(b"".join(table.column("pivots").to_pylist()), np.int32).reshape(len(rep), -1)
        pivot, left, right = (table.column(c)[0].as_py() for c in ("pivot", "left", "right"))
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links = np.zeros(len(rep), np.int64)
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # indicator rows of the pivots that occur here; their products count what two permutations have in common
        names, code = np.unique(own, return_inverse=True)
        has = np.zeros((len(rep), len(names)), np.float32)
        np.put_along_axis(has, code.reshape(own.shape), 1, axis=1)
        listed = np.sort(own[:, :LISTED], axis=1)
        need, step = min(SHARED, own.shape[1]), max(1, (1 << 21) // x.shape[1])
        for s in range(0, len(a), 256):
            i, j = np.nonzero(has[a[s : s + 256]] @ has[b].T >= need)
            i, j = a[s : s + 256][i], b[j]
            if left == right:
                i, j = i[i < j], j[i < j]
            for t in range(0, len(i), step):
                u, v = i[t : t + step], j[t : t + step]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[near], v[near]
                shared = (listed[u][:, :, None] == listed[v][:, None, :]).any(axis=2)
                mine = np.where(shared, listed[u], np.iinfo(np.int32).max).min(axis=1) == pivot
                u, v = u[mine], v[mine]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                found.append((u, v))
        u, v = (np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))
        label = least_connected(len(rep), rank[u], rank[v])[rank]
        some = links > 0
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "least": pa.array(rep[order[label]][some])})

    return run


def link(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    entries = written(_entries(vectors), "entries")
    classes = written(entries.where("vec_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    n = classes.count()
    lists = None
    if n:
        distinct = written(vectors.join(classes, F.col("vec_id") == F.col("rep")).join(entries.select(F.col("vec_id").alias("__v"), F.col("digest").alias("__d")).distinct(), (F.col("__v") == F.col("vec_id")) & (F.col("__d") == F.col("digest"))).select("rep", "weight", "digest", "embedding").dropDuplicates(["rep", "digest"]), "distinct")
        # each length of vectors has pivots of its own
        pivots, first = {}, 0
        for length, vectors_of_it in sorted(distinct.groupBy(F.size("embedding")).count().toLocalIterator()):
            m = min(MOST_PIVOTS, max(1, MOST_BYTES // (8 * length)), max(LEAST_PIVOTS, math.ceil(PER_ROOT * math.sqrt(vectors_of_it))))
            chosen = distinct.where(F.size("embedding") == length).orderBy(F.md5("digest"), "rep").limit(m).select("embedding").toArrow()
            pivots[length] = first, _apart(next(_matrices(chosen.column("embedding").combine_chunks()))[1])
            first += len(pivots[length][1])
        lists = written(_lists(distinct, pivots, nearest), "lists")
        blocks = lists.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = lists.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # a block meets itself and each other block once
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
        compared = written(dealt.groupBy("pivot", "left", "right").applyInArrow(_compare(cosine), "rep long, links long, least long"), "compared")
        links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
        found = components(compared.where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
        classes = classes.join(links, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
        classes = classes.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    else:
        classes = classes.select("digest", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    joined = entries.join(classes.withColumnRenamed("digest", "__d"), (F.col("digest") == F.col("__d")) & F.col("vec_id").isNotNull(), "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
