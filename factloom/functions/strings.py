"""Abstract strings: literals, holes and environment symbols in order.

A value is an array of pieces with one of ``lit`` (text), ``hole`` (why it is unknown: param, field or other) and ``env`` (the
variable's name) set. Adjacent literals are merged and adjacent holes are one, so equal values have equal arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "struct<lit:string,hole:string,hole_pkg:string,env:string>"
STR = f"array<{PIECE}>"


def _piece(lit: Column | None = None, hole: Column | None = None, hole_pkg: Column | None = None, env: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[(none if c is None else c).alias(n) for n, c in (("lit", lit), ("hole", hole), ("hole_pkg", hole_pkg), ("env", env))])


def literal(s: Column) -> Column:
    return F.filter(F.array(_piece(lit=s)), lambda p: p["lit"] != "")


def unknown(cause: Column, pkg: Column | None = None) -> Column:
    return F.array(_piece(hole=cause, hole_pkg=pkg))


def env_symbol(name: Column) -> Column:
    return F.array(_piece(env=name))


def concat(a: Column, b: Column) -> Column:
    def add(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(p["hole"].isNotNull() & last["hole"].isNotNull(), done)
            .when(p["lit"].isNotNull() & last["lit"].isNotNull(), F.concat(head, F.array(_piece(lit=F.concat(last["lit"], p["lit"])))))
            .when(p["lit"] == "", done)
            .otherwise(F.concat(done, F.array(_piece(lit=p["lit"], hole=p["hole"], hole_pkg=p["hole_pkg"], env=p["env"]))))
        )

    return F.aggregate(F.concat(a, b), F.array().cast(STR), add)


def template(s: Column) -> Column:
    """Holes and symbols written as ``{}``."""
    return F.array_join(F.transform(s, lambda p: F.coalesce(p["lit"], F.lit("{}"))), "")


def known(s: Column) -> Column:
    """The string if it is constant throughout, else null."""
    return F.when(F.forall(s, lambda p: p["lit"].isNotNull()), template(s))


def symbol(s: Column) -> Column:
    """With symbols written ``${env:NAME}``; null if a piece is unknown."""
    text = F.array_join(F.transform(s, lambda p: F.coalesce(p["lit"], F.concat(F.lit("${env:"), p["env"], F.lit("}")))), "")
    return F.when(F.forall(s, lambda p: p["hole"].isNull()), text)


def has_literal(s: Column) -> Column:
    return F.exists(s, lambda p: p["lit"].isNotNull() & (p["lit"] != ""))


def leading_hole(s: Column) -> Column:
    return F.coalesce((F.size(s) > 0) & F.try_element_at(s, F.lit(1))["lit"].isNull(), F.lit(False))


def trim_leading_hole(s: Column) -> Column:
    return F.when(leading_hole(s), F.slice(s, 2, F.size(s))).otherwise(s)


def first_cause(s: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(s, lambda p: p["hole"].isNotNull()), F.lit(1))["hole"], F.lit("other"))


def ends_with_slash(s: Column) -> Column:
    return F.coalesce(F.try_element_at(s, F.lit(-1))["lit"].endswith("/"), F.lit(False))


def equal(a: Column, b: Column) -> Column:
    """Piece by piece; why a hole is unknown doesn't matter."""
    plain = lambda s: F.transform(s, lambda p: F.struct(p["hole"].isNotNull().alias("h"), F.coalesce(p["lit"], F.lit("")).alias("l"), F.coalesce(p["env"], F.lit("")).alias("e")))
    return plain(a) == plain(b)


def joined(a: Column, b: Column, slash: Column) -> Column:
    """Joins a prefix and a path of pieces as :func:`factloom.functions.paths.join_path` joins templates."""
    last, first = F.try_element_at(a, F.lit(-1)), F.try_element_at(b, F.lit(1))
    bordered = F.coalesce(last["lit"].endswith("/"), F.lit(False)) | F.coalesce(first["lit"].startswith("/"), F.lit(False))
    gap = ~bordered & (first["lit"].isNull() | slash)
    spaced = F.when(gap, concat(a, literal(F.lit("/")))).otherwise(a)
    return F.when(F.size(b) == 0, a).when(F.size(a) == 0, b).otherwise(concat(spaced, b))
