"""Media columns in progressive JPEG: scans are accumulated into coefficient arrays, which give full-resolution RGB tensors.

A payload is stored without loss in the format's own unit, the 8x8 block of quantised coefficients: each 64 bytes are one
block in zigzag order. A byte b becomes the DC value b, or the AC value b (from 128) or b - 255 (below 128), all of which
have eight significant bits. Blocks fill the MCUs of a YCbCr 4:2:0 image, four of Y, one of Cb, one of Cr, and the payload's
length is kept in a comment segment.

The scans use both kinds of progression: DC by successive approximation from its highest bit down; AC first without its
lowest bit, Y in two spectral bands, then that bit in refinement scans. Every Huffman table the writer needs has a single
code, so its records have one size and are written and read as arrays. The reader handles any other tables, end-of-band
runs and restart markers too, one symbol after another.

Defined results: null text is stored as empty text, which is 64 zero bytes; equal texts give equal files, whatever batch
they are in, as the inverse transform is done in whole numbers; repeated rows are stored alike.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, utf8

UNIT = 64
#: Bytes of payload that are worked on at once.
AT_ONCE = 1 << 20
#: MCUs in a row at most; JPEG sides have 16 bits.
MOST_ACROSS = 4095
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([r * 8 + c for r, c in cells])


def _inverse_transform() -> np.ndarray:
    """Zigzag coefficients @ this = samples, in units of 2**-20. All entries are whole, and so are all sums below 2**53."""
    k = np.arange(8)
    a = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(0.5), 1.0) / 2
    return np.rint(np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)[_zigzag()] * 2**20)


INVERSE = _inverse_transform()


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _shape(payload_bytes: int) -> tuple[int, int]:
    """(MCUs across, MCUs down)."""
    mcus = -(-payload_bytes // (6 * UNIT))
    across = min(mcus, MOST_ACROSS)
    return across, -(-mcus // across)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, slot: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def _scan(components: list[int], start: int, end: int, high: int, low: int, slot: int, data: bytes) -> bytes:
    body = bytes([len(components), *[x for c in components for x in (c, slot)], start, end, high << 4 | low])
    return _segment(0xDA, body) + data.replace(b"\xff", b"\xff\x00")


#: (component, first and last coefficient) of the first AC scans; Y comes in two bands.
AC_BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def encode_group(payloads: list[bytes]) -> list[bytes]:
    """JPEG files of payloads that all need the same number of MCUs."""
    across, down = _shape(len(payloads[0]))
    g, m = len(payloads), across * down
    data = np.zeros((g, m * 6 * UNIT), np.uint8)
    for row, p in zip(data, payloads):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    mcu = data.reshape(g, m, 6, 64)
    y = mcu[:, :, :4].reshape(g, down, across, 2, 2, 64).transpose(0, 1, 3, 2, 4, 5).reshape(g, 4 * m, 64)
    planes = {1: y, 2: mcu[:, :, 4], 3: mcu[:, :, 5]}
    n = -(-6 * m // 8) * 8
    bits = np.ones((g, 8, n), np.uint8)
    bits[:, :, : 6 * m] = np.unpackbits(mcu[:, :, :, 0].reshape(g, 6 * m, 1), axis=2).transpose(0, 2, 1)
    dc = np.packbits(bits, axis=2)
    first = [np.ascontiguousarray(planes[c][:, :, a : b + 1] >> 1) for c, a, b in AC_BANDS]
    refined = {}
    for c, p in planes.items():
        low = (p & 1) ^ (p < 128)
        low[:, :, 0] = 0
        refined[c] = np.packbits(low, axis=2)
    opening = np.ones(n, np.uint8)
    opening[: 6 * m] = 0
    opening = np.packbits(opening).tobytes()
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    tables = _one_code(0, 0, 0x00) + _one_code(1, 0, 0x07) + _one_code(1, 1, 0x00)
    out = []
    for k, p in enumerate(payloads):
        parts = [head, _segment(0xFE, struct.pack(">Q", len(p))), frame, tables, _scan([1, 2, 3], 0, 0, 0, 8, 0, opening)]
        parts += [_scan([c], a, b, 0, 1, 0, f[k].tobytes()) for (c, a, b), f in zip(AC_BANDS, first)]
        parts += [_scan([c], 1, 63, 1, 0, 1, r[k].tobytes()) for c, r in refined.items()]
        parts += [_scan([1, 2, 3], 0, 0, low + 1, low, 0, dc[k, 7 - low].tobytes()) for low in range(7, -1, -1)]
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


class _Image:
    """What the segments of a file say; scans keep their data as written."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        self.payload_bytes, self.restart, self.scans = None, 0, []
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        at = 2
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    self.quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                    body = body[65:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE and len(body) == 8:
                self.payload_bytes = struct.unpack(">Q", body)[0]
            elif marker == 0xDA:
                n = body[0]
                parts = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
                start, end, step = body[1 + 2 * n : 4 + 2 * n]
                end_at = _MARKER.search(data, at).start()
                dc = start == 0
                used = {c: tables.get((0, slot >> 4) if dc else (1, slot & 15)) for c, slot in parts}
                self.scans.append(([c for c, _ in parts], start, end, step >> 4, step & 15, used, data[at:end_at], self.restart))
                at = end_at
        h = max(c[0] for c in self.components.values())
        v = max(c[1] for c in self.components.values())
        self.mcus = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.sampling = (h, v)

    def layout(self) -> tuple:
        """Images with equal layouts can be decoded together."""
        return self.width, self.height, tuple(self.components.items()), tuple((tuple(s[0]), *s[1:5], tuple(sorted((c, t) for c, t in s[5].items() if t)), s[7]) for s in self.scans), tuple((k, v.tobytes()) for k, v in self.quant.items())

    def blocks(self, c: int) -> tuple[int, int]:
        """Blocks across and down of a component, with what fills up the MCUs."""
        h, v, _ = self.components[c]
        return self.mcus[0] * h, self.mcus[1] * v

    def inside(self, c: int) -> tuple[int, int]:
        """Blocks across and down that a scan of this component alone has."""
        h, v, _ = self.components[c]
        return -(-(-(-self.width * h // self.sampling[0])) // 8), -(-(-(-self.height * v // self.sampling[1])) // 8)

    def order(self, scan: tuple) -> list[tuple[int, np.ndarray]]:
        """(component, block places) in the order of a scan; of an interleaved scan, one block of each MCU at a time."""
        if len(scan[0]) == 1:
            c = scan[0][0]
            (across, _), (w, h) = self.blocks(c), self.inside(c)
            return [(c, (np.arange(h)[:, None] * across + np.arange(w)).ravel())]
        out = []
        for c in scan[0]:
            h, v, _ = self.components[c]
            across, rows = self.blocks(c)[0], np.arange(self.mcus[1])[:, None]
            out += [(c, ((rows * v + y) * across + np.arange(self.mcus[0]) * h + x).ravel()) for y in range(v) for x in range(h)]
        return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0xFF
        bit = byte >> (7 - (self.at & 7)) & 1
        self.at += 1
        return bit

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def value(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            out[n, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _any_scan(image: _Image, scan: tuple, coefs: dict[int, np.ndarray]) -> None:
    """One scan of any kind into one image's coefficients, a symbol at a time."""
    parts, start, end, high, low, tables, data, restart = scan
    codes = {c: _codes(t) for c, t in tables.items() if t}
    order = image.order(scan)
    pieces = _RESTART.split(data) if restart else [data]
    units = len(order[0][1])
    per = restart or units
    for k, piece in enumerate(pieces):
        bits, before, run = _Bits(piece.replace(b"\xff\x00", b"\xff")), dict.fromkeys(parts, 0), 0
        for u in range(k * per, min(units, (k + 1) * per)):
            for c, places in order:
                block = coefs[c][places[u]]
                if start == 0:
                    if high:
                        block[0] |= bits.bit() << low
                    else:
                        before[c] += bits.value(bits.symbol(codes[c]))
                        block[0] = before[c] << low
                elif not high:
                    z = start
                    if run:
                        run -= 1
                        continue
                    while z <= end:
                        r, s = divmod(bits.symbol(codes[c]), 16)
                        if s:
                            z += r
                            block[z] = bits.value(s) * (1 << low)
                            z += 1
                        elif r == 15:
                            z += 16
                        else:
                            run = (1 << r) + bits.bits(r) - 1
                            break
                else:
                    z, step = start, 1 << low

                    def correct(z: int) -> None:
                        if bits.bit() and not abs(int(block[z])) & step:
                            block[z] += step if block[z] > 0 else -step

                    if not run:
                        while z <= end:
                            r, s = divmod(bits.symbol(codes[c]), 16)
                            new = 0
                            if s:
                                new = step if bits.bit() else -step
                            elif r < 15:
                                run = (1 << r) + bits.bits(r)
                                break
                            while z <= end:
                                if block[z]:
                                    correct(z)
                                elif r == 0:
                                    if new:
                                        block[z] = new
                                    z += 1
                                    break
                                else:
                                    r -= 1
                                z += 1
                    if run:
                        while z <= end:
                            if block[z]:
                                correct(z)
                            z += 1
                        run -= 1


def _even_scan(image: _Image, scan: tuple, data: list[bytes], coefs: dict[int, np.ndarray]) -> bool:
    """One scan of all images of a layout as arrays, if its records have one size; False if they don't."""
    parts, start, end, high, low, tables, _, restart = scan
    codes = [t for t in tables.values() if t]
    if restart or len({len(d) for d in data}) > 1 or any(sum(t[0]) != 1 or t[0][0] != 1 for t in codes):
        return False
    order, g = image.order(scan), len(data)
    n, width = sum(len(p) for _, p in order), end - start + 1
    stream = np.frombuffer(b"".join(data), np.uint8).reshape(g, -1)
    symbols = {t[1][0] for t in codes}
    if start == 0 and (high or symbols == {0}):
        bits = np.unpackbits(stream, axis=1)[:, :n].reshape(g, len(order[0][1]), len(order))
        for k, (c, places) in enumerate(order):
            if high:
                coefs[c][:, places, 0] |= bits[:, :, k].astype(np.int16) << low
            elif bits.any():
                return False
        return True
    if start == 0 or not symbols:
        return False
    c, places = order[0]
    band = coefs[c][:, :, start : end + 1]
    if len(places) != band.shape[1]:
        return False
    if not high and (s := next(iter(symbols))) and s < 16:
        if s == 7 and stream.shape[1] == n * width:  # a code of one bit and seven more
            value = stream.reshape(g, n, width).astype(np.int16)
            if (stream >> 7).any():
                return False
        else:
            if stream.shape[1] != -(-n * width * (s + 1) // 8):
                return False
            bits = np.unpackbits(stream, axis=1)[:, : n * width * (s + 1)].reshape(g, n, width, s + 1)
            if bits[..., 0].any():
                return False
            value = (bits[..., 1:].astype(np.int16) << np.arange(s - 1, -1, -1, dtype=np.int16)).sum(axis=3, dtype=np.int16)
        band[:] = np.where(value >> (s - 1), value, value - ((1 << s) - 1)) * (1 << low)
        return True
    if high and symbols == {0} and (band != 0).all() and stream.shape[1] == -(-n * (width + 1) // 8):
        bits = np.unpackbits(stream, axis=1)[:, : n * (width + 1)].reshape(g, n, width + 1)
        if bits[..., 0].any():
            return False
        more = bits[..., 1:].astype(np.int16) << low
        band += np.where(band > 0, more, -more)
        return True
    return False


def decode_group(images: list[_Image]) -> dict[int, np.ndarray]:
    """Coefficients by component, (image, block, zigzag place), of images with one layout."""
    image = images[0]
    coefs = {c: np.zeros((len(images), math.prod(image.blocks(c)), 64), np.int16) for c in image.components}
    for k, scan in enumerate(image.scans):
        if not _even_scan(image, scan, [x.scans[k][6].replace(b"\xff\x00", b"\xff") for x in images], coefs):
            for j, x in enumerate(images):
                _any_scan(x, x.scans[k], {c: a[j] for c, a in coefs.items()})
    return coefs


def payload_of(image: _Image, coefs: dict[int, np.ndarray]) -> np.ndarray:
    """(image, MCU, 6, 64) payload bytes, for files that ``encode_group`` wrote."""
    (across, down), g = image.mcus, len(coefs[1])
    y = coefs[1].reshape(g, down, 2, across, 2, 64).transpose(0, 1, 3, 2, 4, 5).reshape(g, across * down, 4, 64)
    values = np.concatenate([y, coefs[2][:, :, None], coefs[3][:, :, None]], axis=2)
    ac = values[..., 1:]
    ac[ac < 0] += 255
    return values.astype(np.uint8)


def pixels_of(image: _Image, coefs: dict[int, np.ndarray]) -> np.ndarray:
    """(image, height, width, 3) RGB, chroma raised to full resolution."""
    planes = []
    for c, (h, v, q) in image.components.items():
        across, down = image.blocks(c)
        whole = (coefs[c] * image.quant[q]).astype(np.float64).reshape(-1, 64) @ INVERSE
        samples = np.clip(np.floor((whole + 2**19) / 2**20) + 128, 0, 255).astype(np.int32)
        plane = samples.reshape(-1, down, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, down * 8, across * 8)
        plane = plane.repeat(image.sampling[1] // v, axis=1).repeat(image.sampling[0] // h, axis=2)
        planes.append(plane[:, : image.height, : image.width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # the JFIF conversion in 16-bit fixed point
    rgb = np.empty((*y.shape, 3), np.uint8)
    rgb[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    rgb[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    rgb[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return rgb


def _grouped(keys: list) -> list[list[int]]:
    groups = defaultdict(list)
    for k, key in enumerate(keys):
        groups[key].append(k)
    return list(groups.values())


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the JPEG file of the whole text)."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            texts = [t or b"" for t in utf8(batch.column("text"))]
            payloads = [padded(t) for t in texts]
            media: list[bytes] = [b""] * len(texts)
            for group in _grouped([_shape(len(p)) for p in payloads]):
                for k, m in zip(group, encode_group([payloads[k] for k in group])):
                    media[k] = m
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload facts, media facts, feature; with ``tensors`` also height, width and rgb (row-major bytes)."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if tensors:
        names, types = [*names, "height", "width", "rgb"], [*types, pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", AT_ONCE):
            media = batch.column("media").to_pylist()
            images = [_Image(m) for m in media]
            rows: list[tuple] = [()] * len(media)
            for group in _grouped([x.layout() for x in images]):
                image, coefs = images[group[0]], decode_group([images[k] for k in group])
                rgb = pixels_of(image, coefs)
                sums = rgb.reshape(len(group), -1, 3).sum(axis=1, dtype=np.int64)
                payload = payload_of(image, coefs)
                for j, k in enumerate(group):
                    p = payload[j].tobytes()[: images[k].payload_bytes]
                    tensor = rgb[j].tobytes()
                    mean = ",".join(f"{s / (image.width * image.height):.4f}" for s in sums[j].tolist())
                    feature = f"{image.width}x{image.height};mean={mean};rgb_crc32={zlib.crc32(tensor):08x}"
                    row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media[k]), hashlib.sha256(media[k]).hexdigest(), feature)
                    rows[k] = (*row, image.height, image.width, tensor) if tensors else row
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", "n_bytes", *names])

    spec = {pa.int64(): "long", pa.string(): "string", pa.int32(): "int", pa.binary(): "binary"}
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, " + ", ".join(f"{n} {spec[t]}" for n, t in zip(names, types)))


def op2_media(spark, sf_dir: str) -> DataFrame:
    return read(store(documents(spark, sf_dir)), tensors=False)
