"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, but most documents share nothing, are at distance one from each other and can't be told apart by
distance to any pivot. So documents that can have no partner are set aside first, by a separate rule, and what is left falls into
regions that share nothing with each other:

1. A partner within the radius holds three quarters of a set. A text whose set shares less than that with the rest of the corpus
   has no partner. One pass over the texts sends the hashes of sets to buckets, which answer how many of a set's are in other sets.
   Of a set, only the ``NEEDED`` and so many least as cover them are sent, which keeps the rule exact.
2. The sets of the others (candidates) are ordered rarest shingle first. Two partners share one of the first quarter plus one.
   Candidates that share one of those are chained into regions by connected components; partners never lie in two regions.

Regions are joined in the metric space, whole sets at hand, as 64-bit hashes:

* Documents spread in the region become its pivots; all distances to them are taken, sets within the radius are linked.
* A set belongs to the Voronoi cell of its nearest pivot. It is replicated to the cell of another pivot if the triangle inequality
  lets a member of that cell be within the radius: its distance to that pivot exceeds that to its own by two radii at most, and the
  cell's greatest distance by one at most.
* Cells are joined recursively, if that leaves fewer pairs than there were. Otherwise distances can't separate the sets, and those
  that are not in the largest component are compared with all. A product of matrices over the most frequent shingles bounds what
  two sets have in common; only pairs that the bound and the distances to the pivots allow are compared as sets.
* Sets already in one component need no comparison, as only components are asked for; a region that is one component is settled.

Regions up to ``REGION`` shingles are joined in one task. Larger ones are dealt to the cells of their pivots by Spark, recursively;
those that distances don't separate are compared block against block. All of it is exact.

Equal sets are one class, named by 128 bits. Mappers send a shingle once however many sets of theirs hold it, so no bucket gets more
of a frequent one than a record from each mapper.

Defined results: null or empty text and rows without doc_id have no shingles and are linked with nothing; rows with equal
ids and texts are one document in several rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import buckets_for, documents, fresh, released, slices, written
from .graph import components, least_connected
from .words import Words, mixed, shingles

SHINGLE = 5
#: Linked if LINK[1] * intersection >= LINK[0] * union.
LINK = (3, 4)
RADIUS = 1 - LINK[0] / LINK[1]
#: Of the shingles that a partner must have, one in so many must be found in other sets for a set to be a candidate.
NEEDED = 3
#: Shingles, and documents, that a mapper sends at a time.
PACKED, MOST_DOCS = 1_500_000, 60_000
#: Shingles of a region, and of a block, that one task takes.
REGION = 4_000_000
#: Pivots of a region; sets that are compared without pivots.
PIVOTS, SMALL = 8, 16
#: Rounds of dealing large regions to cells; cells with a larger share of the pairs of what they came from count as not separated.
ROUNDS, SEPARATED = 4, 0.9
#: Entries of the matrix of frequent shingles, most columns of it, rows that are multiplied at a time.
DENSE, COLUMNS, ROWS = 1 << 23, 8192, 128

_U = np.uint64


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text of fewer words is one shingle."""
    w = Words(column, lower=True)
    every, out = shingles(w.hashes, SHINGLE), []
    for f, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - f >= SHINGLE:
            s = np.sort(every[f : e - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(shingles(w.hashes[f:e], e - f) if e > f else np.empty(0, _U))
    return out


def needed(n):
    """Shingles of a set of n that a partner within the radius has at least."""
    return -(-LINK[0] * n // LINK[1])


def window_size(n):
    """Shingles of a set of n that a partner within the radius must share one of."""
    return n - needed(n) + 1


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values of a sorted array."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return at, np.diff(np.r_[at, len(x)])


def _keys(s: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a shingle, which stand for it when frequencies are counted."""
    return ((s >> _U(40)) % _U(buckets)) << _U(32) | (s & _U(0xFFFFFFFF))


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    b = (keys >> _U(32)).astype(np.int64)
    at, n = _runs(b)
    for x, k in zip(at.tolist(), n.tolist()):
        yield int(b[x]), slice(x, x + k)


def _chunk_id(k: int) -> int:
    return TaskContext.get().partitionId() << 32 | k


# --- candidates -----------------------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text_hash, n, class (null: linked with nothing), candidate: whether the set may have a partner."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "chunk", "idx", "doc_id", "text_hash", "n", "class", "found", "record"]
    schema = f"bucket int, chunk long, idx int, doc_id {kind}, text_hash long, n long, class binary, found long, record binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            chunk = _chunk_id(number)
            home = (TaskContext.get().partitionId() * 31 + number) % buckets
            at = np.repeat(np.array(docs_of, np.int64), [len(s) for s in sent])
            keys = _keys(np.concatenate(sent), buckets) if sent else np.empty(0, _U)
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            first, count = _runs(keys)
            # what several sets of the chunk hold is known to be shared, and is sent once
            several = np.repeat(count > 1, count)
            found = np.bincount(at[several], minlength=held_docs)
            single = ~several
            lone, lone_at, shared = keys[single], at[single].astype(np.uint16), keys[first[count > 1]]
            records: dict[int, list[bytes]] = {}
            for b, x in _by_bucket(lone):
                records.setdefault(b, [b"", b""])[0] = (lone[x] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + lone_at[x].tobytes()
            for b, x in _by_bucket(shared):
                records.setdefault(b, [b"", b""])[1] = (shared[x] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()
            for rows, classes, sizes, idx in rows_of:
                where = np.array(idx, np.int64)
                count = np.where(where >= 0, found[np.maximum(where, 0)] if len(found) else 0, 0)
                spread = np.arange(len(idx)) // 64
                yield pa.RecordBatch.from_arrays([pa.array(((home + spread) % buckets).astype(np.int32)), pa.array([chunk] * len(idx), pa.int64()), pa.array(idx, pa.int32()), rows.column("doc_id"), rows.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(count), pa.nulls(len(idx), pa.binary())], names)
            # the last row says how many answers there will be
            lists = [[*records, home], [len(v[0]) // 6 for v in records.values()] + [len(records)], [b"".join(v) for v in records.values()] + [None]]
            m = len(lists[0])
            yield pa.RecordBatch.from_arrays([pa.array(lists[0], pa.int32()), pa.array([chunk] * m, pa.int64()), pa.array([-2] * (m - 1) + [-3], pa.int32()), pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.array(lists[1], pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(lists[2], pa.binary())], names)

        released()
        number, id_type = 0, None
        sent, docs_of, rows_of, held, held_docs = [], [], [], 0, 0
        seen: dict[bytes, int] = {}
        for batch in slices(batches, "text", 1 << 22):
            id_type = batch.column("doc_id").type
            valid = batch.column("doc_id").is_valid().to_pylist()
            rows = batch.select(["doc_id", "text_hash"])
            classes, sizes, idx = [], [], []
            for s, ok in zip(shingle_sets(batch.column("text")), valid):
                sizes.append(len(s))
                if not len(s) or not ok:
                    classes.append(None)
                    idx.append(-1)
                    continue
                c = xxhash.xxh3_128_digest(s.data)
                classes.append(c)
                if c not in seen:
                    seen[c] = held_docs
                    share = -(-needed(len(s)) // NEEDED)
                    sent.append(s[: len(s) - needed(len(s)) + share])
                    docs_of.append(held_docs)
                    held += len(sent[-1])
                    held_docs += 1
                idx.append(seen[c])
            rows_of.append((rows, classes, sizes, idx))
            if held >= PACKED or held_docs >= MOST_DOCS // 2:
                yield from flush()
                number += 1
                sent, docs_of, rows_of, held, held_docs = [], [], [], 0, 0
                seen.clear()
        if rows_of:
            yield from flush()
        released()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of, chunks, lone, at, shared = [], [], [], [], []
        for batch in batches:
            message = pc.equal(batch.column("idx"), -2)
            rest = batch.filter(pc.invert(message))
            if rest.num_rows:
                yield rest
            batch = batch.filter(message)
            for b, c, n, record in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "n", "record"))):
                high = _U(b) << _U(32)
                lone.append(np.frombuffer(record, np.uint32, n).astype(_U) | high)
                at.append(np.frombuffer(record, np.uint16, n, 4 * n))
                shared.append(np.frombuffer(record, np.uint32, offset=6 * n).astype(_U) | high)
                buckets_of.append(b)
                chunks.append(c)
        if chunks:
            lengths = [len(x) for x in lone]
            keys, known = np.concatenate(lone), np.unique(np.concatenate(shared))
            order = np.argsort(keys)
            first, count = _runs(keys[order])
            twice = (count > 1) | _among(keys[order][first], known)
            hit = np.empty(len(keys), bool)
            hit[order] = np.repeat(twice, count)
            cuts = np.cumsum(lengths)[:-1]
            answers = [x[h].tobytes() for x, h in zip(at, np.split(hit, cuts))]
            m = len(chunks)
            for s in range(0, m, 1024):
                k = min(1024, m - s)
                yield pa.RecordBatch.from_arrays([pa.array(buckets_of[s : s + k], pa.int32()), pa.array(chunks[s : s + k], pa.int64()), pa.array([-2] * k, pa.int32()), pa.nulls(k, arrow_id), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(answers[s : s + k], pa.binary())], names)
        released()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, got, due = [], {}, {}, {}
        for batch in batches:
            kinds = batch.column("idx").to_numpy()
            some = batch.filter(pa.array(kinds >= -1))
            if some.num_rows:
                rows.append(some.select(["chunk", "idx", "doc_id", "text_hash", "n", "class", "found"]))
            for c, n in zip(*(batch.filter(pa.array(kinds == -3)).column(k).to_pylist() for k in ("chunk", "n"))):
                due[c] = due.get(c, 0) + n
            for c, record in zip(*(batch.filter(pa.array(kinds == -2)).column(k).to_pylist() for k in ("chunk", "record"))):
                got[c] = got.get(c, 0) + 1
                if c not in found:
                    found[c] = np.zeros(MOST_DOCS, np.int32)
                found[c] += np.bincount(np.frombuffer(record, np.uint16), minlength=MOST_DOCS)[:MOST_DOCS].astype(np.int32)
        if got != {c: n for c, n in due.items() if n}:
            raise RuntimeError("answers are missing: a mapper that ran again dealt its documents in another order; pass a table that was written")
        for batch in rows:
            idx, chunk, n, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("idx", "chunk", "n", "found"))
            total = own.astype(np.int64)
            for c in np.unique(chunk).tolist():
                if c in found:
                    here = np.flatnonzero((chunk == c) & (idx >= 0))
                    total[here] += found[c][idx[here]]
            share = -(-needed(n) // NEEDED)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "text_hash", "n", "class")), pa.array((idx >= 0) & (total >= share))], ["doc_id", "text_hash", "n", "class", "candidate"])
        released()

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    answered = docs.mapInArrow(send, schema).repartition(buckets, "bucket").mapInArrow(answer, schema)
    return answered.repartition(buckets, "chunk").mapInArrow(decide, f"doc_id {kind}, text_hash long, n long, class binary, candidate boolean")


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


# --- regions --------------------------------------------------------------------------------------------------------------------


def _packed_sets(texts: DataFrame) -> DataFrame:
    """(chunk, classes, sizes, sets): the sets of candidates, ``PACKED`` shingles to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_chunk_id(number)], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([np.array([len(s) for s in held.values()], np.uint32).tobytes()], pa.binary()), pa.array([np.concatenate([*held.values()]).tobytes()], pa.binary())], ["chunk", "classes", "sizes", "sets"])

        number, size = 0, 0
        held: dict[bytes, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 22):
            for c, s in zip(batch.column("class").to_pylist(), shingle_sets(batch.column("text"))):
                if c not in held:
                    held[c] = s
                    size += len(s)
            if size >= PACKED:
                yield out()
                held, size, number = {}, 0, number + 1
        if held:
            yield out()
        released()

    return texts.mapInArrow(run, "chunk long, classes binary, sizes binary, sets binary")


class _Chunk:
    """The sets of a packed row: ``classes``, and their shingles ``s`` with the number ``of`` the set of each."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.classes = [row["classes"][k : k + 16] for k in range(0, len(row["classes"]), 16)]
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.s = np.frombuffer(row["sets"], _U)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def counted(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, in how many of the sets each is, which of them each shingle has)."""
        keys, inverse, count = np.unique(_keys(self.s, buckets), return_inverse=True, return_counts=True)
        return keys, count, inverse


def _frequencies(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, answers): for each bucket that the chunk has keys of, in how many sets these are, up to 255."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = _Chunk(batch.slice(k, 1).to_pylist()[0])
                keys, count, _ = chunk.counted(buckets)
                count = np.minimum(count, 255).astype(np.uint8)
                rows = [(b, (keys[x] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + count[x].tobytes()) for b, x in _by_bucket(keys)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk.id] * len(rows), pa.int64()), pa.array([r for _, r in rows], pa.binary())], ["bucket", "chunk", "record"])
        released()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, counts = [], [], []
        for batch in batches:
            for b, c, record in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "record"))):
                n = len(record) // 5
                keys.append(np.frombuffer(record, np.uint32, n).astype(_U) | _U(b) << _U(32))
                counts.append(np.frombuffer(record, np.uint8, n, 4 * n))
                rows.append((c, b))
        if rows:
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.minimum(np.bincount(inverse, weights=np.concatenate(counts)), 255).astype(np.uint8)[inverse]
            parts = [x.tobytes() for x in np.split(total, np.cumsum([len(k) for k in keys])[:-1])]
            for s in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows[s : s + 1024]], pa.int64()), pa.array([b for _, b in rows[s : s + 1024]], pa.int32()), pa.array(parts[s : s + 1024], pa.binary())], ["chunk", "bucket", "record"])
        released()

    replies = chunks.mapInArrow(send, "bucket int, chunk long, record binary").repartition(buckets, "bucket").mapInArrow(answer, "chunk long, bucket int, record binary")
    return replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "record"))).alias("answers"))


def _stars(cells: np.ndarray, of: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (cell, number below m): the least number that each is connected to, and the distinct (cell, that number)."""
    order = np.lexsort((of, cells))
    cells, of = cells[order], of[order]
    first, count = _runs(cells)
    label = least_connected(m, of, np.repeat(of[first], count))
    return label, cells[first], label[of[first]]


def _near(chunks: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that connect the classes whose windows share a shingle."""
    asked = chunks.join(_frequencies(chunks, buckets).withColumnRenamed("chunk", "__c"), F.col("chunk") == F.col("__c")).drop("__c")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = _Chunk(row)
                _, _, inverse = chunk.counted(buckets)
                often = np.frombuffer(b"".join(a["record"] for a in row["answers"]), np.uint8)[inverse]
                # a chunk has its sets one after another, each in order of its shingles, so a stable sort leaves those in order
                order = np.argsort(chunk.of << 8 | often, kind="stable")
                start = np.cumsum(chunk.sizes) - chunk.sizes
                rank = np.arange(len(order)) - np.repeat(start, chunk.sizes)
                inside = order[(rank < np.repeat(window_size(chunk.sizes), chunk.sizes)) & (often[order] > 1)]
                label, cells, of = _stars(chunk.s[inside], chunk.of[inside], len(chunk.classes))
                moved = np.flatnonzero(label != np.arange(len(label)))
                rows = [(-1 - int(i) % buckets, chunk.classes[i], chunk.classes[label[i]]) for i in moved.tolist()]
                b = (mixed(cells) % _U(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                first, count = _runs(b[order])
                for x, n in zip(first.tolist(), count.tolist()):
                    at = order[x : x + n]
                    rows.append((int(b[at[0]]), cells[at].tobytes(), b"".join([chunk.classes[i] for i in of[at].tolist()])))
                for s in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[s : s + 4096]], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "a", "b"])
        released()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, classes = [np.empty(0, _U)], []
        for batch in batches:
            own = pc.less(batch.column("bucket"), 0)
            if pc.any(own).as_py():
                yield batch.filter(own).select(["a", "b"])
            for a, b in zip(*(batch.filter(pc.invert(own)).column(k).to_pylist() for k in ("a", "b"))):
                cells.append(np.frombuffer(a, _U))
                classes.append(b)
        named = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), sum(map(len, cells)), [None, pa.py_buffer(b"".join(classes))]).dictionary_encode()
        names = named.dictionary.to_pylist()
        label, _, _ = _stars(np.concatenate(cells), named.indices.to_numpy().astype(np.int64), len(names))
        moved = np.flatnonzero(label != np.arange(len(label))).tolist()
        for s in range(0, len(moved), 1 << 16):
            some = moved[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.binary()), pa.array([names[label[i]] for i in some], pa.binary())], ["a", "b"])
        released()

    return asked.mapInArrow(send, "bucket int, a binary, b binary").repartition(buckets, "bucket").mapInArrow(meet, "a binary, b binary")


def _unpacked(chunks: DataFrame) -> DataFrame:
    """(class, n, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = _Chunk(batch.slice(k, 1).to_pylist()[0])
                cuts = np.cumsum(chunk.sizes) * 8
                raw = chunk.s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(chunk.classes, pa.binary()), pa.array(chunk.sizes), pa.array([raw[e - 8 * n : e] for e, n in zip(cuts.tolist(), chunk.sizes.tolist())], pa.binary())], ["class", "n", "set"])

    return chunks.mapInArrow(run, "class binary, n long, set binary")


# --- joins of regions -----------------------------------------------------------------------------------------------------------


class _Region:
    """Sets in memory. ``label`` has the least number that each is known to be connected to."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.n) - self.n
        self.codes, self.flag = codes, np.zeros(len(distinct), np.int32)
        self.label = np.arange(len(sets))

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some sets, one after another, and where each begins."""
        if len(rows) == len(self.n):
            return self.codes, self.start
        n = self.n[rows]
        first = np.cumsum(n) - n
        return self.codes[np.arange(n.sum()) + np.repeat(self.start[rows] - first, n)], first

    def common(self, i: int, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own = self.codes[self.start[i] : self.start[i] + self.n[i]]
        self.flag[own] = 1
        out = np.add.reduceat(self.flag[part[0]], part[1])
        self.flag[own] = 0
        return out

    def link(self, i: int, rows: np.ndarray, common: np.ndarray) -> None:
        union = self.n[i] + self.n[rows] - common
        found = rows[LINK[1] * common >= LINK[0] * union]
        labels = np.unique(self.label[np.r_[found, i]])
        if len(labels) == 2:
            self.label[self.label == labels[1]] = labels[0]
        elif len(labels) > 2:
            self.label[np.isin(self.label, labels)] = labels[0]

    def held(self, codes: np.ndarray) -> np.ndarray:
        """For each of the codes of some sets, how many of the sets have it."""
        np.add.at(self.flag, codes, 1)
        out = self.flag[codes]
        self.flag[codes] = 0
        return out

    def join(self, rows: np.ndarray) -> None:
        """Connects all linked sets among ``rows``."""
        if (self.label[rows] == self.label[rows[0]]).all():
            return
        if len(rows) <= SMALL:
            return self.compare(self.outside(rows), rows)
        part, taken, far = self.part(rows), [], np.full(len(rows), 2.0)
        central = np.add.reduceat(self.held(part[0]), part[1]) / self.n[rows]
        distances = np.empty((len(rows), min(PIVOTS, len(rows))))
        for k in range(distances.shape[1]):
            # the first pivot is the set whose shingles most sets have, each further one the set that is farthest from those before
            i = int(far.argmax() if k else central.argmax())
            common = self.common(rows[i], part)
            distances[:, k] = 1 - common / (self.n[rows[i]] + self.n[rows] - common)
            self.link(rows[i], rows, common)
            taken.append(i)
            far = np.minimum(far, distances[:, k])
            far[i] = -1
        if (self.label[rows] == self.label[rows[0]]).all():
            return
        home = distances.argmin(axis=1)
        cells = [_cell(distances, home, k) for k in range(distances.shape[1])]
        if sum(len(c) ** 2 for c in cells) > SEPARATED * len(rows) ** 2:
            return self.compare(self.outside(rows), rows, distances)
        for cell in cells:
            if len(cell):
                self.join(rows[cell])

    def outside(self, rows: np.ndarray) -> np.ndarray:
        """Those of ``rows`` that are not in the largest component among them."""
        names, size = np.unique(self.label[rows], return_counts=True)
        return rows[self.label[rows] != names[size.argmax()]]

    def compare(self, left: np.ndarray, right: np.ndarray, distances: np.ndarray | None = None) -> None:
        """Connects each set of ``left`` with those of ``right`` that it is linked with; ``distances`` are those of ``right`` to pivots, with ``left`` among it."""
        if not len(left) or not len(right):
            return
        every = np.unique(np.r_[left, right])
        codes, first = self.part(every)
        at, to, n = np.searchsorted(every, left), np.searchsorted(every, right), self.n[every]
        # frequent shingles are columns of a matrix; of the others that several sets have, two sets share what the smaller number says at most
        count = self.held(codes)
        columns = np.unique(codes[count > max(1, len(every) // 32)])
        most = min(COLUMNS, max(64, DENSE // len(every)))
        self.flag[codes] = count
        columns = columns[np.argsort(-self.flag[columns], kind="stable")[:most]]
        self.flag[codes] = 0
        self.flag[columns] = np.arange(1, len(columns) + 1)
        column = self.flag[codes] - 1
        self.flag[columns] = 0
        inside = column >= 0
        dense = np.zeros((len(every), len(columns)), np.float32)
        dense[np.repeat(np.arange(len(every)), n)[inside], column[inside]] = 1
        rest = np.add.reduceat((count > 1) & ~inside, first, dtype=np.int64)
        # the least set that one could be linked with decides whether it has enough shingles that others have
        sizes = np.sort(n[to])
        least = np.searchsorted(sizes, needed(n[at]))
        some = (least < len(sizes)) & (sum(LINK) * (dense[at].sum(axis=1) + rest[at]) >= LINK[0] * (n[at] + sizes[np.minimum(least, len(sizes) - 1)]))
        left, at, others = left[some], at[some], np.ascontiguousarray(dense[to].T)
        own = None if distances is None else np.searchsorted(right, left, sorter=np.argsort(right))
        own = own if own is None else np.argsort(right)[own]
        for s in range(0, len(left), ROWS):
            x = at[s : s + ROWS]
            bound = (dense[x] @ others).astype(np.float64) + np.minimum(rest[x][:, None], rest[to])
            near = sum(LINK) * bound >= LINK[0] * (n[x][:, None] + n[to])
            for k, i in enumerate(left[s : s + ROWS].tolist()):
                c = np.flatnonzero(near[k])
                c = c[self.label[right[c]] != self.label[i]]
                if own is not None and len(c):
                    c = c[(np.abs(distances[c] - distances[own[s + k]]) <= RADIUS + 1e-9).all(axis=1)]
                c, step = c[np.argsort(-bound[k, c], kind="stable")], SMALL
                while len(c):
                    now, c = right[c[:step]], c[step:]
                    self.link(i, now, self.common(i, self.part(now)))
                    c, step = c[self.label[right[c]] != self.label[i]], 4 * step


def _cell(distances: np.ndarray, home: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the sets of pivot k's Voronoi cell, and of those that the triangle inequality doesn't keep from its members."""
    own = home == k
    if not own.any():
        return np.empty(0, np.int64)
    d = distances[:, k]
    window = (d - distances.min(axis=1) <= 2 * RADIUS + 1e-9) & (d <= d[own].max() + RADIUS + 1e-9)
    return np.flatnonzero(own | window)


def _joined(classes: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """(class, class that it is connected to) of a region."""
    region = _Region(sets)
    region.join(np.arange(len(sets)))
    return [(classes[i], classes[x]) for i, x in enumerate(region.label.tolist()) if i != x]


def _whole_regions(members: DataFrame) -> DataFrame:
    """Links (a, b) of regions that come whole: rows (region, class, set), sorted by region in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], pa.binary()) for j in (0, 1)], ["a", "b"])

        region, held, found = None, {}, []
        for batch in batches:
            for r, c, s in zip(*(batch.column(k).to_pylist() for k in ("region", "class", "set"))):
                if r != region:
                    found += _joined([*held], [*held.values()]) if len(held) > 1 else []
                    region, held = r, {}
                held[c] = np.frombuffer(s, _U)
            yield rows(found)
            found = []
        yield rows(_joined([*held], [*held.values()]) if len(held) > 1 else [])
        released()

    return members.mapInArrow(run, "a binary, b binary")


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """Distances of members to the pivots of their region; ``home`` marks the nearest (-1 in ``pivot``: no pivot shares anything)."""
    sets = [np.frombuffer(s, _U) for c in ("set",) for t in (left, right) for s in t.column(c).to_pylist()]
    m, k = left.num_rows, right.num_rows
    out: dict[str, list] = {c: [] for c in ("region", "class", "pivot", "distance", "home", "linked")}
    if m and k:
        region, rows = _Region(sets), np.arange(m)
        part = region.part(rows)
        common = np.array([region.common(m + j, part) for j in range(k)])
        union = region.n[m:, None] + region.n[None, :m] - common
        distance, linked = 1 - common / union, LINK[1] * common >= LINK[0] * union
        home = np.where(distance.min(axis=0) < 1, distance.argmin(axis=0), k)
        pivots, name = [*right.column("class").to_pylist(), None], left.column("region")[0].as_py()
        for i, c in enumerate(left.column("class").to_pylist()):
            for j in range(k + 1):
                out["region"].append(name)
                out["class"].append(c)
                out["pivot"].append(pivots[j])
                out["distance"].append(float(distance[j, i]) if j < k else 1.0)
                out["home"].append(bool(home[i] == j))
                out["linked"].append(bool(j < k and linked[j, i]))
    return pa.table({"region": pa.array(out["region"], pa.binary()), "class": pa.array(out["class"], pa.binary()), "pivot": pa.array(out["pivot"], pa.binary()), "distance": pa.array(out["distance"], pa.float64()), "home": pa.array(out["home"], pa.bool_()), "linked": pa.array(out["linked"], pa.bool_())})


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the members of two blocks."""
    a, b = ({c: np.frombuffer(s, _U) for c, s in zip(t.column("class").to_pylist(), t.column("set").to_pylist())} for t in (left, right))
    found = []
    if a and b:
        both = {**a, **b}
        names = [*both]
        region, number = _Region([*both.values()]), {c: i for i, c in enumerate(names)}
        region.compare(np.array([number[c] for c in a]), np.array([number[c] for c in b]))
        found = [(names[i], names[x]) for i, x in enumerate(region.label.tolist()) if i != x]
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def _labelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``rows`` with the component that each class is known to be in."""
    if not links:
        return rows.withColumn("component", F.col("class"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    known = components(every)
    return rows.join(known, F.col("class") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "class").alias("component"))


def _large_regions(members: DataFrame) -> list[DataFrame]:
    """Links of regions that are too large for a task. ``members`` has region, class, n, set."""
    links: list[DataFrame] = []
    for turn in range(ROUNDS):
        size = written(members.groupBy("region").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets")), "sizes")
        large = size.where(F.col("shingles") > REGION)
        small = members.join(size.where(F.col("shingles") <= REGION).select("region"), "region", "left_semi")
        links.append(written(_whole_regions(small.select("region", "class", "set").repartition("region").sortWithinPartitions("region")), "links"))
        if large.isEmpty():
            return links
        members = written(members.join(large.select("region", (F.ceil(F.col("shingles") / REGION) * 2).cast("int").alias("parts"), "sets"), "region"), "members")
        order = Window.partitionBy("region").orderBy(F.xxhash64("class", F.lit(turn)), "class")
        pivots = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * PIVOTS).drop("r")
        pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("region", "part", "class", "set")
        dealt = members.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).select("region", "part", "class", "set")
        kind = "region binary, class binary, pivot binary, distance double, home boolean, linked boolean"
        measured = written(dealt.groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInArrow(_measured, kind), "measured")
        links.append(written(measured.where("linked AND class != pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")), "links"))
        # the cells with their windows
        radius = measured.where("home").groupBy("region", F.coalesce("pivot", F.lit(b"")).alias("p")).agg(F.max("distance").alias("radius"))
        own = measured.groupBy("region", "class").agg(F.min("distance").alias("nearest"))
        near = measured.withColumn("p", F.coalesce("pivot", F.lit(b""))).join(radius, ["region", "p"]).join(own, ["region", "class"])
        inside = F.col("home") | ((F.col("distance") - F.col("nearest") <= 2 * RADIUS + 1e-9) & (F.col("distance") <= F.col("radius") + RADIUS + 1e-9))
        cells = written(near.where(inside).select("region", "class", F.unhex(F.md5(F.concat(F.col("region"), F.col("p"), F.lit(bytes([turn]))))).alias("cell")), "cells")
        # a region whose cells aren't smaller stays whole, and gets other pivots in the next round
        before = members.select("region", "sets").distinct()
        pairs = cells.groupBy("region", "cell").agg(F.count("*").cast("double").alias("k")).groupBy("region").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
        split = written(pairs.join(before, "region").select("region", (F.col("pairs") <= SEPARATED * F.col("sets").cast("double") * F.col("sets")).alias("split")), "split")
        parts = cells.join(split.where("split").select("region"), "region", "left_semi").unionByName(members.join(split.where("NOT split").select("region"), "region", "left_semi").select("region", "class", F.col("region").alias("cell")))
        labels = _labelled(parts, links)
        alive = labels.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("cell")
        members = written(parts.join(alive, "cell", "left_semi").join(members.select("region", "class", "n", "set"), ["region", "class"]).select(F.col("cell").alias("region"), "class", "n", "set"), "members")
        if split.where("split").isEmpty():
            break
    # what distances don't separate: sets outside the largest component of a region against all of it, block against block
    labels = written(_labelled(members.select("region", "class"), links), "labels")
    heads = labels.groupBy("region", "component").agg(F.count("*").alias("k")).groupBy("region").agg(F.max(F.struct("k", "component")).alias("h")).select("region", F.col("h.component").alias("head"))
    rest = written(members.join(labels.join(heads, "region").where("component != head").select("region", "class"), ["region", "class"], "left_semi"), "rest")
    blocks = lambda x, name: x.groupBy("region").agg((F.ceil(F.sum("n") / REGION) * 4).cast("int").alias(name))
    parts = written(blocks(members, "rights").join(blocks(rest, "lefts"), "region"), "parts")
    block = lambda name: F.pmod(F.xxhash64("class"), F.col(name)).cast("int")
    across = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rest.join(parts, "region").withColumn("block", block("lefts")).withColumn("other", across("rights")).select("region", "block", "other", "class", "set")
    right = members.join(parts, "region").withColumn("other", block("rights")).withColumn("block", across("lefts")).select("region", "block", "other", "class", "set")
    met = left.groupBy("region", "block", "other").cogroup(right.groupBy("region", "block", "other"))
    links.append(written(met.applyInArrow(_compared, "a binary, b binary"), "links"))
    return links


def class_components(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, component): the least class that each of the candidates (class, rep, h, n) is connected to, but for those that are least."""
    spark = docs.sparkSession
    texts = docs.join(candidates.hint("shuffle_hash"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("h"))).select("class", "text")
    chunks = written(_packed_sets(texts), "sets")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = components(_near(chunks, buckets))
    regions = found.select(F.col("node").alias("member"), F.col("component").alias("region"))
    regions = written(regions.unionByName(regions.select(F.col("region").alias("member"), "region").distinct()), "regions")
    size = regions.join(candidates.select(F.col("class").alias("member"), "n"), "member").groupBy("region").agg(F.sum("n").alias("shingles"))
    large = written(size.where(F.col("shingles") > REGION).select("region"), "large")
    members = _unpacked(chunks).join(regions, F.col("class") == F.col("member")).select("region", "class", "n", "set")
    if large.isEmpty():
        return components(_whole_regions(members.select("region", "class", "set").repartition("region").sortWithinPartitions("region")))
    members = written(members, "members")
    whole = members.join(large, "region", "left_anti").select("region", "class", "set").repartition("region").sortWithinPartitions("region")
    links = _whole_regions(whole)
    for more in _large_regions(members.join(large, "region", "left_semi").dropDuplicates(["region", "class"])):
        links = links.unionByName(more)
    return components(links)


def _clustered(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, keeper: one row per row of ``docs`` (doc_id, text, text_hash)."""
    buckets = buckets_for(docs)
    signed = written(signatures(docs, buckets), "signatures")
    least = signed.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("n").alias("n"), F.max("candidate").alias("candidate"))
    classes = written(least.select("class", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("h"), "n", "candidate"), "classes")
    found = class_components(docs, classes.where("candidate").select("class", "rep", "h", "n"))
    label = classes.join(found, F.col("class") == F.col("node"), "left").select(F.col("class").alias("member"), "rep", "h", F.coalesce("component", "class").alias("component"))
    least = label.groupBy("component").agg(F.min(F.struct("rep", "h")).alias("r"))
    named = label.join(least, "component").select("member", F.col("r.rep").alias("component_id"), F.col("r.h").alias("keeper_hash"))
    joined = signed.join(named, F.col("class") == F.col("member"), "left")
    keeper = F.col("class").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash")))
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(keeper, F.lit(False)).alias("keeper"))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: one row per row of ``docs``."""
    return _clustered(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))).drop("keeper")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the least (by id, then text hash) of its component.

    Rows that repeat that one stay once; rows without doc_id and texts without words stay as they are.
    """
    h, d, k = fresh(docs, "hash", "id", "key")
    signed = docs.withColumn(h, F.xxhash64("text"))
    keepers = _clustered(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))).where("keeper AND doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(k)).distinct()
    stay = signed.join(keepers, (F.col("doc_id") == F.col(d)) & (F.col(h) == F.col(k)), "left_semi").dropDuplicates(["doc_id", h])
    bare = signed.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return stay.select(*columns).unionByName(bare.select(*columns))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


#: Every pair that shares a shingle, by counting; links closed transitively.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sets
"""
