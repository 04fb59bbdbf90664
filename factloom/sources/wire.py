"""The protobuf wire format, driven by the message lists of :mod:`factloom.sources.schema`."""

from __future__ import annotations

import struct
from typing import Any

from .schema import ENUMS, MESSAGES


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint is too long")


def _scalar(kind: str, value: int) -> Any:
    if kind == "bool":
        return bool(value)
    if kind == "int32":
        value &= 0xFFFFFFFF
        return value - (1 << 32) if value >> 31 else value
    if kind == "uint32":
        return value & 0xFFFFFFFF
    if kind.startswith("enum:"):
        names = ENUMS[kind[5:]]
        return names[value] if value < len(names) else str(value)
    return value


def _default(kind: str) -> Any:
    if kind in MESSAGES:
        return None
    return {"string": "", "bytes": b"", "bool": False, "float": 0.0}.get(kind, ENUMS[kind[5:]][0] if kind.startswith("enum:") else 0)


def decode(message: str, data: bytes) -> dict[str, Any]:
    """A message as a dict of all its fields; unknown fields are skipped, damaged data raises ValueError."""
    fields = {n: (name, kind, repeated) for n, name, kind, repeated in MESSAGES[message]}
    out: dict[str, Any] = {name: [] if repeated else _default(kind) for name, kind, repeated in fields.values()}
    at = 0
    try:
        while at < len(data):
            tag, at = _varint(data, at)
            number, wire = tag >> 3, tag & 7
            if wire == 0:
                raw, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                raw, at = data[at : at + size], at + size
            elif wire == 2:
                size, at = _varint(data, at)
                raw, at = data[at : at + size], at + size
                if len(raw) < size:
                    raise ValueError("the data ends within a field")
            else:
                raise ValueError(f"wire type {wire}")
            if number not in fields:
                continue
            name, kind, repeated = fields[number]
            if kind in MESSAGES:
                value = decode(kind, raw)
            elif kind == "string":
                value = raw.decode()
            elif kind == "bytes":
                value = raw
            elif kind == "float":
                value = struct.unpack("<f", raw)[0]
            elif wire == 2:  # a packed list
                k = 0
                while k < len(raw):
                    v, k = _varint(raw, k)
                    out[name].append(_scalar(kind, v))
                continue
            else:
                value = _scalar(kind, raw)
            if repeated:
                out[name].append(value)
            else:
                out[name] = value
    except (IndexError, TypeError, UnicodeDecodeError, struct.error) as e:
        raise ValueError(f"damaged {message}: {e}") from e
    return out


def _put(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(kind: str, value: Any) -> int:
    return ENUMS[kind[5:]].index(value) if kind.startswith("enum:") else int(value)


def encode(message: str, row: Any) -> bytes:
    """The message's bytes, fields in order of number; what equals its default is left out. ``row`` is a dict or Row."""
    get = row.get if isinstance(row, dict) else lambda n: row[n]
    out = []
    for number, name, kind, repeated in MESSAGES[message]:
        value = get(name)
        values = (value or []) if repeated else [value]
        numeric = kind not in MESSAGES and kind not in ("string", "bytes", "float")
        if repeated and numeric:
            if values:
                body = b"".join(_put(_number(kind, v)) for v in values)
                out.append(_put(number << 3 | 2) + _put(len(body)) + body)
            continue
        for v in values:
            if v is None or not repeated and v == _default(kind):
                continue
            if kind in MESSAGES:
                body = encode(kind, v)
            elif kind in ("string", "bytes"):
                body = v.encode() if isinstance(v, str) else bytes(v)
            elif kind == "float":
                out.append(_put(number << 3 | 5) + struct.pack("<f", v))
                continue
            else:
                out.append(_put(number << 3) + _put(_number(kind, v)))
                continue
            out.append(_put(number << 3 | 2) + _put(len(body)) + body)
    return b"".join(out)
