"""Paths, patterns and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an unresolved piece is written, and the catch-all segment.
HOLE, CATCH_ALL = "{}", "{*}"


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _canon_segment(seg: Column) -> Column:
    catch_all = _any(
        seg.startswith("*"),
        seg == CATCH_ALL,
        seg.startswith("{") & seg.endswith("...}"),
        (seg.startswith("[...") | seg.startswith("[[...")) & seg.endswith("]"),
    )
    parameter = _any(seg.contains("{"), seg.contains("["), seg.startswith(":"))
    return F.when(seg == "{$}", F.lit("")).when(catch_all, F.lit(CATCH_ALL)).when(parameter, F.lit(HOLE)).otherwise(seg)


def canon_path(template: Column) -> Column:
    """The canonical HTTP path of a route or URL template.

    Authority, query and fragment go; empty and ``{$}`` segments go; parameters become ``{}`` and catch-alls ``{*}``, after
    which nothing survives.
    """
    path = F.regexp_replace(template, r"(?i)^(https?:)?//[^/]*", "")
    path = F.regexp_replace(path, r"(?s)[?#].*$", "")
    segments = F.filter(F.transform(F.split(path, "/"), _canon_segment), lambda s: s != "")
    end = F.array_position(segments, CATCH_ALL).cast("int")
    return F.concat(F.lit("/"), F.array_join(F.when(end > 0, F.slice(segments, F.lit(1), end)).otherwise(segments), "/"))


def contract_name(method: Column, path: Column) -> Column:
    return F.concat(F.lit("http:"), method, F.lit(" "), path)


def topic_name(topic: Column) -> Column:
    return F.concat(F.lit("msg:kafka:"), topic)


def grpc_name(package: Column, service: Column, method: Column) -> Column:
    return F.concat(package, F.lit("."), service, F.lit("/"), method)


def graphql_name(type_name: Column, field: Column) -> Column:
    return F.concat(F.lit("graphql:"), type_name, F.lit("."), field)


def pattern_method(pattern: Column) -> Column:
    """The method of a mux pattern ``[METHOD ][HOST]/path``; empty without one. A pattern that starts with a hole is all path."""
    return F.when(pattern.startswith(HOLE), F.lit("")).otherwise(F.regexp_extract(pattern, r"^([^ \t/]*)[ \t]", 1))


def pattern_path(pattern: Column) -> Column:
    rest = F.regexp_replace(pattern, r"^[^ \t/]*[ \t]+", "")
    hosted = F.when(rest.contains("/"), F.regexp_replace(rest, r"^[^/]+", "")).otherwise(F.when(rest.contains(HOLE), rest).otherwise(F.lit("")))
    # only what stands before the first hole can be a host
    head = F.substring_index(rest, HOLE, 1)
    plain = F.when(rest.startswith("/") | (rest == ""), rest).when(rest.contains(HOLE) & ~head.contains("/"), rest).otherwise(hosted)
    return F.when(pattern.startswith(HOLE), pattern).otherwise(plain)


def subtree(path: Column) -> Column:
    """A pattern that ends in a slash serves everything below it."""
    return F.when(path.endswith("/"), F.concat(path, F.lit(CATCH_ALL))).otherwise(path)


def display(path: Column) -> Column:
    p = F.regexp_replace(path, "/{2,}", "/")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def join_path(prefix: Column, path: Column, slash: Column | bool) -> Column:
    """Joins templates without losing a segment's border: a hole that starts ``path`` is a segment of its own; with ``slash``
    a literal gets a separator too."""
    literal = ~path.startswith(HOLE)
    bordered = (prefix.endswith("/")) | path.startswith("/")
    slash = F.lit(slash) if isinstance(slash, bool) else slash
    apart = F.concat(prefix, F.when(~bordered & (~literal | slash), F.lit("/")).otherwise(""), path)
    joined = F.when(path == "", prefix).when(prefix == "", path).otherwise(apart)
    return F.regexp_replace(joined, r"(\{\}){2,}", "{}")


def client_path(template: Column) -> Column:
    """A client's URL for :func:`canon_path`: an unresolved base before a relative literal stays a segment of its own."""
    rest = F.substring(template, 3, 1 << 30)
    glued = template.startswith(HOLE) & (rest != "") & ~rest.rlike(r"^([/?#]|\{\})")
    return F.when(glued, F.concat(F.lit(HOLE + "/"), rest)).otherwise(template)


def sprintf_template(format_: Column) -> Column:
    """Verbs become holes, ``%%`` a percent sign; adjacent holes are one."""
    guarded = F.replace(format_, F.lit("%%"), F.lit("\u0001"))
    holes = F.regexp_replace(guarded, r"%[^A-Za-z]*([A-Za-z]|$)", "{}")
    return F.replace(F.regexp_replace(holes, r"(\{\}){2,}", "{}"), F.lit("\u0001"), F.lit("%"))


def lcfirst(name: Column) -> Column:
    """Lower-cases the first letter, or a leading acronym up to the letter that starts the next word."""
    upper = F.length(F.regexp_extract(name, r"^\p{Lu}*", 0))
    n = F.when((upper > 1) & (upper < F.length(name)), upper - 1).otherwise(upper)
    return F.concat(F.lower(F.left(name, n)), F.substring(name, n + 1, F.length(name)))


def sanitize(name: Column) -> Column:
    return F.translate(name, "/\\:", "___")


def short(commit: Column, n: int = 8) -> Column:
    return F.left(commit, F.lit(n))


def has_literal_segment(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: ~s.isin("", HOLE, CATCH_ALL))


def relative_file(file: Column, root: Column) -> Column:
    """``file`` relative to ``root`` if it lies below it."""
    return F.when(file.startswith(F.concat(root, F.lit("/"))), F.substring(file, F.length(root) + 2, F.length(file))).otherwise(file)


def scope_list(text: Column, default: str = "./...") -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(default))).otherwise(parts)


def field_id(tag: Column, index: Column) -> Column:
    """A protobuf field number from the struct tag, else the field's index."""
    return F.coalesce(F.expr("int(null)") if tag is None else F.nullif(F.regexp_extract(tag, r'protobuf:"[^,"]*,(\d+)', 1), F.lit("")).cast("int"), index)
