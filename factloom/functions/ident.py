"""Content-addressed identities: SHA-256 over length-prefixed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(field: Column | str) -> Column:
    return (F.lit(field) if isinstance(field, str) else field).cast("binary")


def framed(field: Column | str, endian: str = "little") -> Column:
    """Eight bytes of length, then the bytes themselves."""
    data = _bytes(field)
    big = F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0"))
    if endian == "big":
        return F.concat(big, data)
    pairs = F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")
    little = F.unhex(F.concat(*[F.substring(pairs, 15 - 2 * k, 2) for k in range(8)]))
    return F.concat(little, data)


def digest(*fields: Column | str, endian: str = "little") -> Column:
    """Lower-case hex of the SHA-256 over the framed fields."""
    return F.sha2(F.concat(*[framed(f, endian) for f in fields]), 256)


def iid(owner: Column | str, package: Column | str, symbol: Column | str, signature: Column | str) -> Column:
    return digest(owner, package, symbol, signature)


def contract_iid(name: Column, kind: str) -> Column:
    return digest("", "", name, kind)


def placeholder_iid(name: Column) -> Column:
    """The identity of a callee that is known by name alone."""
    return digest("", "", name, "")


def cell_symbol(package: Column, type_name: Column, field: Column) -> Column:
    return digest("", package, type_name, F.concat(F.lit("field:"), field.cast("string")))


def interface_tag(type_string: Column) -> Column:
    return digest("", "", F.concat(F.lit("type:"), type_string), "")


def owner(module: Column, repo: Column) -> Column:
    """The module that declares the package, else the repository."""
    return F.coalesce(F.nullif(module, F.lit("")), repo)


def set_digest(sorted_binaries: Column) -> Column:
    """SHA-256 over an array of binaries, one after another without lengths."""
    return F.sha2(F.unhex(F.array_join(F.transform(sorted_binaries, F.hex), "")), 256)


def body_id(body: Column, callees: Column) -> Column:
    """SHA-256 over the framed body and the framed callees in byte order; ``callees`` is an array of binaries, kept with repeats."""
    parts = F.transform(F.sort_array(callees), lambda c: F.hex(framed(c)))
    return F.sha2(F.unhex(F.concat(F.hex(framed(body)), F.array_join(parts, ""))), 256)


def entries_digest(entries: Column, names: tuple[str, ...]) -> Column:
    """SHA-256 over the big-endian framed fields of structs in an array; how method sets and interfaces are fingerprinted."""
    parts = F.transform(entries, lambda e: F.concat(*[F.hex(framed(e[n], "big")) for n in names]))
    return F.sha2(F.unhex(F.array_join(parts, "")), 256)


def function_name(receiver: Column, package: Column, name: Column, type_args: Column | None = None) -> Column:
    """``(*pkg.T).m``, ``(pkg.T).m`` or ``pkg.f``, with type arguments in brackets."""
    pointer = receiver.startswith("*")
    bare = F.regexp_replace(receiver, r"^\*", "")
    method = F.concat(F.lit("("), F.when(pointer, F.lit("*")).otherwise(""), package, F.lit("."), bare, F.lit(")."), name)
    plain = F.when(F.coalesce(receiver, F.lit("")) == "", F.concat(package, F.lit("."), name)).otherwise(method)
    if type_args is None:
        return plain
    return F.when(F.size(type_args) > 0, F.concat(plain, F.lit("["), F.array_join(type_args, " "), F.lit("]"))).otherwise(plain)
