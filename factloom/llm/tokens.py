"""SentencePiece BPE by a table of last tokens.

A prefix of a text has one BPE encoding, and so one last token. A token that ends at a place is that last token exactly if
it can stand next to the last token of the prefix before it. So a text is encoded by one pass of an automaton over all
pieces, which lists the tokens that end at each place, and a test of pairs; the ids are then read off backwards.

Two tokens can stand side by side if BPE, run on their joined string, never merges across the seam. The test replays both
merge histories from the seam outwards, without running BPE.

No piece holds the word mark after another character, so no merge crosses such a place and texts are cut there. Of a megabyte
of texts each distinct cut is encoded once, and decoded once from its ids; encodings are kept in a bounded table of each Python worker,
which the worker's next task of another operator empties, or a timer when none of this one follows.

Defined results: null text is encoded as empty text, and empty text has no ids; repeated rows are encoded alike; columns
besides those named are dropped.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABLES, documents, released, slices, tables_kept
from .words import Words, hashed, mixed

MARK = "▁"
#: Entries of each of the two generations of a worker's tables: of encoded cuts, and of answers about pairs.
KEPT = 250_000
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x0A]] = True


_CUT = re.compile(f"[{MARK}\n]*[^{MARK}\n]+|[{MARK}\n]+")


class Kept(dict):
    """A table of at most two generations of ``KEPT`` entries: what is asked for moves to the younger; the older one goes when that is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def emptied(self) -> None:
        self.clear()
        self.old = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """Encodes and decodes as the model's own library does, without begin or end ids."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        # that merges come in order of score is all that is used of it
        self.order = sorted((i for i in range(n) if not special[i]), key=lambda i: -sp.get_score(i))
        self.rank = {i: r for r, i in enumerate(self.order)}
        self.ids = {self.pieces[i]: i for i in self.order}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = {}
        for i in range(n):
            if sp.is_byte(i):
                self.surface[b"%d" % i] = bytes([int(self.pieces[i][3:5], 16)])
            elif sp.is_control(i):
                self.surface[b"%d" % i] = b""
            elif sp.is_unknown(i):
                self.surface[b"%d" % i] = b" \xe2\x81\x87 "
            else:
                self.surface[b"%d" % i] = self.pieces[i].replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the word mark after another character; texts can't be cut at words")
        self.halves: dict[int, tuple[int, int]] = {}
        for i in self.order:
            if len(self.pieces[i]) > 1 and (halves := self._last_merge(self.pieces[i])):
                self.halves[i] = halves
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or i in self.halves:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # (whether two tokens can stand side by side) by the two ids in one number
        self.fits = Kept(lambda pair: self._compatible(pair >> 20, pair & 0xFFFFF))
        self.kept = Kept(self._encoded)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``piece`` when BPE runs on it alone; None if BPE never makes it."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(((self.rank[self.ids[m]], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.ids), default=None)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return (self.ids[parts[0]], self.ids[parts[1]]) if parts[0] in self.ids and parts[1] in self.ids else None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, time until which it stands at the seam) from the character at the seam to the whole token."""
        down = [token]
        while down[-1] in self.halves:
            down.append(self.halves[down[-1]][side])
        out, now = [], -1
        for lower, upper in zip(down[::-1], down[-2::-1] or []):
            now = max(now, self.rank[upper])
            out.append((lower, now))
        return [*out, (token, len(self.order))]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the seam between the two tokens alone."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            joined = self.ids.get(self.pieces[x] + self.pieces[y])
            if joined is not None:
                r = self.rank[joined]
                # of equal ranks the leftmost goes first: what ends x lies left of the seam, what ends y lies right
                if r < x_until and r <= y_until and r < len(self.order):
                    return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if x_until <= y_until and i < len(a) - 1:
                i += 1
            else:
                j += 1

    def _cut_ids(self, cut: str) -> list[int]:
        last: list[int] = [-1] * len(cut)
        size: list[int] = [0] * len(cut)
        fits = self.fits
        for end, (token, n) in self.automaton.iter(cut):
            if last[end] >= 0:
                continue
            start = end - n
            if start >= 0 and (before := last[start]) >= 0:
                if not fits[before << 20 | token]:
                    continue
            elif start >= 0 and cut[start] in self.ids:
                continue
            last[end], size[end] = token, n
        ids: list[int] = []
        end = len(cut) - 1
        while end >= 0:
            if last[end] < 0:  # a character without a piece
                ids.extend(self.byte_ids[b] for b in reversed(cut[end].encode()))
                end -= 1
            else:
                ids.append(last[end])
                end -= size[end]
        return ids[::-1]

    def _encoded(self, cut: str) -> bytes | tuple[bytes, bytes]:
        """Decimal ids of a cut joined by commas; with the bytes that they stand for, where these aren't the cut with its marks as spaces."""
        ids = ",".join(map(str, self._pieces_of(cut))).encode()
        surface = self.surface_of(ids)
        return ids if surface == cut.replace(MARK, " ").encode() else (ids, surface)

    def cuts(self, text: str) -> list[str]:
        """Runs of marks and line ends stay with the word that follows; a run at the end is a cut of its own."""
        return _CUT.findall(MARK + text.replace(" ", MARK)) if text else []

    def of_cut(self, cut: str) -> tuple[bytes, bytes, int]:
        """(decimal ids joined by commas, the bytes that they stand for, number of ids) of a cut."""
        value = self.kept[cut] if len(cut) <= 64 else self._encoded(cut)
        ids, surface = (value, cut.replace(MARK, " ").encode()) if isinstance(value, bytes) else value
        return ids, surface, ids.count(b",") + 1

    def encode(self, text: str) -> str:
        """The decimal ids, joined by commas."""
        return b",".join([self.of_cut(c)[0] for c in self.cuts(text)]).decode()

    def encode_column(self, column: pa.Array) -> Iterator[tuple[bytes, bytes, int]]:
        """For each text (null: empty) its ids joined by commas, the bytes they stand for, and their number."""
        w = Words(column, separators=_BETWEEN)
        has = w.first[1:] > w.first[:-1]
        heads, raw = w.first[:-1][has], w.data.tobytes()
        # what stands between a word and the one before it, or the text's start
        behind = np.r_[0, w.ends[:-1]]
        behind[heads] = w.offsets[:-1][has]
        size, gap = w.ends - w.starts, w.starts - behind
        keys = w.hashes + np.uint64(3) * hashed(w.data, behind, w.starts)
        keys[heads] ^= np.uint64(0xD6E8FEB86659FD93)
        codes, _ = pd.factorize(mixed(keys))
        found = np.full(codes.max(initial=-1) + 1, -1)
        found[codes[::-1]] = np.arange(len(codes))[::-1]
        # equal digests are equal cuts but for one slice in very many, which is then encoded text by text
        if MARK.encode() in raw or (size != size[found[codes]]).any() or (gap != gap[found[codes]]).any():
            for value in column:
                parts = [self.of_cut(c) for c in self.cuts(value.as_py() or "")]
                yield b",".join([p[0] for p in parts]), b"".join([p[1] for p in parts]), sum(p[2] for p in parts)
            return
        of_cut, head = self.of_cut, np.zeros(len(codes), bool)
        head[heads] = True
        entries = [of_cut(MARK * h + raw[b:s].decode().replace(" ", MARK) + raw[s:e].decode()) for h, b, s, e in zip(head[found].tolist(), behind[found].tolist(), w.starts[found].tolist(), w.ends[found].tolist())]
        ids, surfaces = [x[0] for x in entries], [x[1] for x in entries]
        counts = np.r_[0, np.cumsum(np.array([x[2] for x in entries], np.int64)[codes])] if entries else np.zeros(1, np.int64)
        ended = np.maximum(w.offsets[:-1], np.r_[0, w.ends][w.first[1:]])
        codes_ = codes.tolist()
        for f, e, end, stop in zip(w.first[:-1].tolist(), w.first[1:].tolist(), ended.tolist(), w.offsets[1:].tolist()):
            here = codes_[f:e]
            a, b, n = [ids[k] for k in here], [surfaces[k] for k in here], int(counts[e] - counts[f])
            if end < stop:
                more = of_cut(MARK * (f == e) + raw[end:stop].decode().replace(" ", MARK))
                a.append(more[0])
                b.append(more[1])
                n += more[2]
            yield b",".join(a), b"".join(b), n

    def _pieces_of(self, cut: str) -> list[int]:
        if "\n" not in cut or "\n" in self.ids:
            return self._cut_ids(cut)
        ids: list[int] = []
        for k, line in enumerate(cut.split("\n")):
            if k:
                ids.append(self.byte_ids[10])
            ids += self._cut_ids(line) if line else []
        return ids

    def surface_of(self, ids: bytes) -> bytes:
        """The bytes that comma-joined ids stand for."""
        surface = self.surface
        return b"".join([surface[i] for i in ids.split(b",")]) if ids else b""

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids; bytes that are no UTF-8 become U+FFFD, one for each."""
        return text_of(self.surface_of(ids.encode()))


def text_of(raw: bytes) -> str:
    """The library drops the space that it put before a text."""
    raw = raw[1:] if raw[:1] == b" " else raw
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="factloom-each-byte")


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("factloom-each-byte", _each_byte)

_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _encoders:
        _encoders[model] = made = Encoder(model)
        TABLES.extend([made.kept.emptied, made.fits.emptied])
    return _encoders[model]


def encode(docs: DataFrame, model: str | None = None, id_column: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (comma-joined), ids_sha256, decoded, decoded_sha256; without ids and decoded unless ``keep_ids``."""
    model = model or default_model()
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        with tables_kept():
            for batch in slices(batches, "text", 1 << 20):
                rows: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded": [], "decoded_sha256": []}
                for ids, raw, n in enc.encode_column(batch.column("text")):
                    decoded = text_of(raw)
                    rows["n_tokens"].append(n)
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        rows["ids"].append(ids.decode())
                        rows["decoded"].append(decoded)
                if not keep_ids:
                    del rows["ids"], rows["decoded"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, pa.int64() if k == "n_tokens" else pa.string()) for k, v in rows.items()]], ["doc_id", *rows])
                del rows
                released(tables=False)

    more = "ids string, ids_sha256 string, decoded string, decoded_sha256 string" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, {more}")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), keep_ids=False)
