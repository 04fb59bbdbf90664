"""Substring dedup by recompression: words covered by a passage that a document with a smaller id also has are removed.

Recompression shortens a sequence of symbols round by round. First every run of one symbol becomes one symbol; then, with the
symbols split at random into left and right ones, every pair of a left and a right symbol becomes one. A name is a digest of
what it stands for, so all tasks give a run or pair the same name without a table of names, and whether two neighbours are
joined depends on these two alone. Equal passages therefore have equal symbols inside, but for a few at their ends: a run
that touches an end may go on beyond it, and the symbol next to it may be joined with what it becomes.

A window of words is keyed by the symbols that are certain inside it: the longest of the second round, or else of the first,
or else, in the few windows that have none, the window itself. The key is a function of the window's words alone, so equal
windows have equal keys. Two Spark rounds settle which windows are repeated:

1. Each chunk of documents sends its distinct keys to their buckets, which answer with one bit each: is it in another chunk?
   A window whose key is in one document only isn't repeated. This leaves little but the repeats.
2. Each chunk sends the digests of its remaining windows, with the smallest id that has each in the chunk, to buckets that
   answer with one bit each: does a smaller id have it in another chunk?

However many documents share a passage, a chunk sends it once. The answers are joined back to the chunks, which were written
to the shared folder, and each chunk removes its words. Windows are told apart by 96 bits, not by their words: among 10^13 windows
the chance that any two different ones agree is under 1 in 1000.

Defined results: null text has no words; rows without doc_id neither lose words nor make others lose any; rows with equal ids
don't take from each other; a text from which nothing is removed stays as it is; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, documents, released, slices, written
from .words import Words, mixed

#: Words of a window.
WINDOW = 13
#: Bytes of text in a chunk.
CHUNK = 4 << 20

_U = np.uint64


class Level:
    """Symbols of one round over a sequence: runs, then left-right pairs of runs."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, salt: int):
        first = np.r_[True, names[1:] != names[:-1]]
        self.run_of = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        length = np.diff(np.r_[starts, len(names)])
        run = names[starts]
        many = length > 1
        run[many] = mixed(run[many] + mixed(length[many].astype(_U) + _U(salt)))
        size = np.add.reduceat(sizes, starts)
        # a symbol is left or right by a digest that differs between rounds; the sequence ends with a left one
        self.left = np.r_[(mixed(run + _U(salt * 0x9E37)) >> _U(63)) == 0, True, True]
        opens = self.left[: len(run)] & ~self.left[1 : len(run) + 1]
        closes = np.r_[False, opens[:-1]]
        at = np.flatnonzero(~closes)
        self.symbol_of = np.r_[np.cumsum(~closes) - 1, len(at), len(at)]
        pair = opens[at]
        self.names, self.sizes = run[at], size[at]
        second = at[pair] + 1
        self.names[pair] = mixed(self.names[pair] * _U(3) + mixed(run[second] + _U(salt + 1)))
        self.sizes[pair] += size[second]
        self.run_start = starts

    def certain(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of this round's symbols that are certain, given that positions lo..hi-1 of the sequence are and no more."""
        runs = len(self.run_start)
        # the run at an end may go on; the next may be joined with it, unless it is a left one (right one at the other end)
        f = self.run_of[lo] + 1
        f = f + ~self.left[f]
        e = self.run_of[hi - 1]
        e = e - self.left[np.maximum(e - 1, 0)]
        ok = f < e
        f, e = np.minimum(f, runs), np.clip(e, 0, runs)
        return self.symbol_of[f], np.where(ok, self.symbol_of[e], self.symbol_of[f])


def _best(level: Level, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The longest symbol of each range, of equally long ones that of the least name."""
    value = (level.names >> _U(4)) | ((_U(15) - np.minimum(level.sizes, 15).astype(_U)) << _U(60))
    out = value[lo]
    for k in range(1, int((hi - lo).max(initial=0))):
        at = np.flatnonzero(hi - lo > k)
        out[at] = np.minimum(out[at], value[lo[at] + k])
    return out


def window_digests(h: np.ndarray, n: int = WINDOW, seed: int = 0) -> np.ndarray:
    """Digests of all windows of n, put together from windows of powers of two."""
    out, width, at = None, 1, 0
    power = mixed(h ^ _U(seed)) if seed else h
    while n >> at:
        if n >> at & 1:
            done = n & ((1 << at) - 1)
            tail = power[done:] if done else power
            out = tail if out is None else mixed(out[: len(tail)] * _U(5) + mixed(tail + _U(at + 1)))
        width, at = width * 2, at + 1
        if n >> at:
            half = width // 2
            power = mixed(power[:-half] * _U(7) + mixed(power[half:] + _U(977 + at)))
    return out[: len(h) - n + 1]


def window_keys(h: np.ndarray, starts: np.ndarray, digests: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """A key for the window at each start, from nothing but the window's words."""
    one = Level(h, np.ones(len(h), np.int64), 1)
    lo, hi = one.certain(starts, starts + n)
    keys = mixed(digests ^ _U(0xA5A5)) | _U(1)
    some = np.flatnonzero(lo < hi)
    keys[some] = _best(one, lo[some], hi[some]) << _U(1)
    two = Level(one.names, one.sizes, 11)
    lo, hi = two.certain(lo[some], hi[some])
    deep = lo < hi
    keys[some[deep]] = mixed(_best(two, lo[deep], hi[deep]))
    return keys


class Chunk:
    """The windows of a chunk's documents that have an id."""

    def __init__(self, rows: pa.RecordBatch, keyed: bool = True):
        self.rows = rows
        self.words = w = Words(rows.column("text"))
        h, self.first = w.hashes, w.first[:-1]
        self.counts = np.diff(w.first)
        ids = rows.column("doc_id")
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        # windows start where WINDOW words follow in a document that has an id
        last = np.where(valid, np.maximum(self.first, w.first[1:] - WINDOW + 1), self.first)
        edges = np.zeros(len(h) + 1, np.int64)
        np.add.at(edges, self.first, 1)
        np.add.at(edges, last, -1)
        self.starts = np.flatnonzero(np.cumsum(edges)[: len(h)])
        doc = np.repeat(np.arange(len(valid)), self.counts)[self.starts]
        self.doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        if len(self.starts):
            digests = window_digests(h)
            self.digests = digests[self.starts]
            self.keys = window_keys(h, self.starts, self.digests) if keyed else np.empty(0, _U)
        else:
            self.digests = self.keys = np.empty(0, _U)

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the kept words joined by one space, where each document's begin, one more than documents)."""
        w = self.words
        kept = np.flatnonzero(keep)
        row = np.searchsorted(w.first, kept, side="right") - 1
        follows = np.r_[row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)]
        begin, end = w.starts[kept], w.ends[kept] + follows
        data = w.data.copy()
        data[w.ends[kept[follows]]] = 0x20
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begin] += 1
        edges[end[end < len(edges)]] -= 1
        out = data[np.cumsum(edges, dtype=np.int8)[: len(data)].astype(bool)]
        size = np.bincount(row, weights=end - begin, minlength=len(self.counts)).astype(np.int64)
        return out, np.r_[0, np.cumsum(size)]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, whether several documents of the chunk have each)."""
        if not len(self.keys):
            return self.keys, np.empty(0, bool)
        fresh = np.flatnonzero(np.r_[True, (self.keys[1:] != self.keys[:-1]) | (self.doc[1:] != self.doc[:-1])])
        k, d = self.keys[fresh], self.doc[fresh]
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return k[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)

    def repeated(self, answers: dict[int, bytes] | None, buckets: int) -> np.ndarray:
        """Numbers of the windows whose key is in several documents, by what the buckets answered."""
        keys, several = self.distinct_keys()
        shared = keys[several | _answered(keys, answers, buckets)]
        return np.flatnonzero(np.isin(self.keys, shared))

    def least(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct digests, 32 further bits of each, smallest id that has each, which of them each window has)."""
        d = self.digests[windows]
        more = (window_digests(self.words.hashes, seed=0x5BD1E995)[self.starts[windows]] if len(windows) else d) >> _U(32)
        order = np.lexsort((more, d))
        fresh = np.r_[True, (d[order][1:] != d[order][:-1]) | (more[order][1:] != more[order][:-1])] if len(d) else np.empty(0, bool)
        inverse = np.empty(len(d), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, self.doc[windows])
        return d[first], more[first].astype(np.uint32), low, inverse


def _bucket(digests: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(digests + _U(0xB5)) % _U(buckets)).astype(np.int64)


def _dealt(digests: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, numbers of its digests), in a fixed order."""
    b = _bucket(digests, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]]) if len(b) else []
    for x, y in zip(cuts, np.r_[cuts[1:], len(b)] if len(b) else []):
        yield int(b[order[x]]), order[x:y]


def _answered(digests: np.ndarray, answers: dict[int, bytes] | None, buckets: int) -> np.ndarray:
    out = np.zeros(len(digests), bool)
    for b, at in _dealt(digests, buckets):
        if answers and b in answers:
            out[at] = np.unpackbits(np.frombuffer(answers[b], np.uint8))[: len(at)].astype(bool)
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, rows): documents with all their columns, some megabytes to a row, as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        k = 0
        task = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([task + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, "text", CHUNK):
            held.append(batch)
            size += sum(x or 0 for x in pc.binary_length(batch.column("text")).to_pylist())
            if size >= CHUNK // 2:
                yield out()
                held, size, k = [], 0, k + 1
        if held:
            yield out()
        released()

    return docs.mapInArrow(run, "chunk long, rows binary")


def _opened(rows: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(rows).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _ask(chunks: DataFrame, message: Callable, answer: Callable, buckets: int) -> DataFrame:
    """Sends each chunk's messages to their buckets and returns what these answer: (chunk, answers as bucket -> bits)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                sent = list(message(one))
                yield pa.RecordBatch.from_arrays([pa.array([one.column("chunk")[0].as_py()] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int32()), pa.array([m for _, m in sent], pa.binary())], ["chunk", "bucket", "message"])
                del sent
                released()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has whole buckets, but may have several of them
        got: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for c, b, m in zip(*(batch.column(k).to_pylist() for k in ("chunk", "bucket", "message"))):
                got.setdefault(b, []).append((c, m))
        for b, records in got.items():
            # what a chunk sends to a negative bucket is a note to itself
            bits = [m for _, m in records] if b < 0 else [np.packbits(x).tobytes() for x in answer([m for _, m in records])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in records], pa.int64()), pa.array([b] * len(records), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])
        released()

    replies = chunks.mapInArrow(send, "chunk long, bucket int, message binary").repartition(buckets, "bucket").mapInArrow(reply, "chunk long, bucket int, bits binary")
    # a chunk has at most one answer from each bucket
    return written(replies.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("answers")), "answers")


def _answers(batch: pa.RecordBatch, column: str) -> dict[int, bytes]:
    return dict(batch.column(column)[0].as_py() or [])


def _is_shared(messages: list[bytes]) -> list[np.ndarray]:
    """Of keys cut to five bytes: those that come twice."""
    sizes = [len(m) // 5 for m in messages]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(messages), np.uint8).reshape(-1, 5)
    _, inverse, count = np.unique(wide.view(_U).ravel(), return_inverse=True, return_counts=True)
    return np.split((count > 1)[inverse], np.cumsum(sizes)[:-1])


def _has_smaller(messages: list[bytes]) -> list[np.ndarray]:
    """Of digests with ids: those whose digest comes with a smaller id too."""
    digests, more, ids = [], [], []
    for m in messages:
        n = len(m) // 20
        digests.append(np.frombuffer(m, _U, n))
        more.append(np.frombuffer(m, np.uint32, n, 8 * n))
        # ids by byte planes, which compress well
        ids.append(np.ascontiguousarray(np.frombuffer(m, np.uint8, 8 * n, 12 * n).reshape(8, n).T).view(np.int64).ravel())
    d, e, every = np.concatenate(digests), np.concatenate(more), np.concatenate(ids)
    order = np.lexsort((every, e, d))
    d, e = d[order], e[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (e[1:] != e[:-1])]) if len(d) else np.empty(0, np.int64)
    least = np.repeat(every[order][first], np.diff(np.r_[first, len(d)]))
    out = np.empty(len(d), bool)
    out[order] = least < every[order]
    return np.split(out, np.cumsum([len(x) for x in digests])[:-1])


def _removed(docs: DataFrame, output: Callable[[Chunk, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``output`` of each chunk with the mask of its kept words."""
    buckets = buckets_for(docs, 16 << 20) * 2
    chunks = written(_chunks(docs), "chunks")

    def keys(one: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        k, _ = Chunk(_opened(one.column("rows")[0].as_py())).distinct_keys()
        for b, at in _dealt(k, buckets):
            yield b, np.ascontiguousarray(k[at].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()

    shared = _ask(chunks, keys, _is_shared, buckets).select(F.col("chunk").alias("__c"), F.col("answers").alias("shared"))
    keyed = chunks.join(shared, F.col("chunk") == F.col("__c"), "left").drop("__c")

    def windows(one: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        chunk = Chunk(_opened(one.column("rows")[0].as_py()))
        open_ = chunk.repeated(_answers(one, "shared"), buckets)
        d, more, low, _ = chunk.least(open_)
        note = np.zeros(len(chunk.starts), bool)
        note[open_] = True
        yield -1 - one.column("chunk")[0].as_py() % buckets, np.packbits(note).tobytes()
        for b, at in _dealt(d, buckets):
            yield b, d[at].tobytes() + more[at].tobytes() + np.ascontiguousarray(low[at].view(np.uint8).reshape(-1, 8).T).tobytes()

    smaller = _ask(keyed, windows, _has_smaller, buckets).select(F.col("chunk").alias("__c"), F.col("answers").alias("smaller"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                chunk, answers = Chunk(_opened(one.column("rows")[0].as_py()), keyed=False), _answers(one, "smaller")
                note = next(bits for b, bits in answers.items() if b < 0)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(note, np.uint8))[: len(chunk.starts)])
                d, _, low, which = chunk.least(at)
                gone = _answered(d, answers, buckets)[which] | (low[which] < chunk.doc[at])
                total = int(chunk.counts.sum())
                edges = np.zeros(total + 1, np.int64)
                np.add.at(edges, chunk.starts[at[gone]], 1)
                np.add.at(edges, chunk.starts[at[gone]] + WINDOW, -1)
                keep = np.cumsum(edges)[:total] == 0
                yield output(chunk, keep)
                del chunk, answers
                released()

    return chunks.join(smaller, F.col("chunk") == F.col("__c")).drop("__c").mapInArrow(remove, schema)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def output(chunk: Chunk, keep: np.ndarray) -> pa.RecordBatch:
        text, first = chunk.kept(keep)
        raw = memoryview(text)
        gone = chunk.counts - np.diff(np.r_[0, np.cumsum(keep)][chunk.words.first])
        return pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), pa.array(chunk.counts), pa.array(gone), pa.array([hashlib.sha256(raw[f:e]).hexdigest() for f, e in zip(first[:-1].tolist(), first[1:].tolist())], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), output, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``; texts that lose words become their kept words, joined by one space."""

    def output(chunk: Chunk, keep: np.ndarray) -> pa.RecordBatch:
        text, first = chunk.kept(keep)
        raw = text.tobytes()
        gone = chunk.counts - np.diff(np.r_[0, np.cumsum(keep)][chunk.words.first])
        texts = chunk.rows.column("text").to_pylist()
        for k in np.flatnonzero(gone).tolist():
            texts[k] = raw[first[k] : first[k + 1]].decode()
        at = chunk.rows.schema.get_field_index("text")
        return chunk.rows.set_column(at, chunk.rows.schema.field(at), pa.array(texts, chunk.rows.schema.field(at).type))

    return _removed(docs, output, docs.schema)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir))


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows), range(0, 13) r(k) WHERE least < doc_id
), one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT o.doc_id, count(*) AS n, string_agg(o.word, ' ' ORDER BY o.i) AS t FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i WHERE g.i IS NULL GROUP BY o.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
