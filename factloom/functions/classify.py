"""Predicates and classifications of files, packages, types and functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PB_SEGMENTS = ("pb", "api")
MOCK_SEGMENTS = ("mock", "mocks")
MOCK_GENERATORS = ("MockGen", "mockery", "github.com/gojuno/minimock", "counterfeiter", "moq")
NULL_WRAPPER_MODULES = (
    "github.com/guregu/null", "gopkg.in/guregu/null", "github.com/volatiletech/null",
    "github.com/volatiletech/sqlboiler/types/null", "google.golang.org/protobuf/types/known/wrapperspb",
)
KAFKA_PACKAGES = ("github.com/segmentio/kafka-go", "github.com/IBM/sarama", "github.com/Shopify/sarama", "github.com/twmb/franz-go/pkg/kgo")
BY_REF_KINDS = ("pointer", "slice", "map")
SEND_METHODS, RECV_METHODS = ("Send", "SendMsg", "SendAndClose"), ("Recv", "RecvMsg", "CloseAndRecv")
ROOT_TYPES = ("Query", "Mutation", "Subscription", "Entity")


def segments(text: str) -> tuple[str, ...]:
    """A comma-separated list of path segments; a segment with a slash is refused."""
    out = tuple(s for s in (x.strip() for x in text.split(",")) if s)
    if bad := [s for s in out if "/" in s]:
        raise ValueError(f"{bad[0]!r} is not one path segment")
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def pb_match(package: Column, segs: Sequence[str] = PB_SEGMENTS) -> Column:
    """A segment inside the path or at its end; a bare top-level one doesn't match."""
    out = F.lit(False)
    for s in segs:
        out = out | package.contains(f"/{s}/") | package.endswith(f"/{s}")
    return out


def mock_path(package: Column, segs: Sequence[str] = MOCK_SEGMENTS) -> Column:
    return F.arrays_overlap(F.split(package, "/"), F.array(*[F.lit(s) for s in segs])) if segs else F.lit(False)


def mock_file_name(path: Column) -> Column:
    return base_name(path).endswith("_mock.go") | base_name(path).startswith("zzz_")


def mock_header(comment: Column) -> Column:
    """A generated-code line of a mock generator, named as a whole word."""
    names = "|".join(n.replace(".", r"\.") for n in MOCK_GENERATORS)
    return comment.rlike(rf"^// Code generated by (http://)?(https://)?({names})($|[^0-9A-Za-z_]).*DO NOT EDIT\.\r*$")


def test_file(path: Column) -> Column:
    return path.endswith("_test.go")


def generator(path: Column, is_mock: Column) -> Column:
    base = base_name(path)
    return F.when(base.endswith(".pb.go"), "PROTOC").when(base.endswith(".generated.go") | base.endswith("models_gen.go"), "GQLGEN").when(is_mock, "MOCKGEN").otherwise("NONE")


def origin(package: Column, module: Column) -> Column:
    user = (module != "") & ((package == module) | package.startswith(F.concat(module, F.lit("/"))))
    return F.when(user, "USER").when(~F.substring_index(package, "/", 1).contains("."), "STDLIB").otherwise("DEP")


def by_ref(kind: Column, container_writes: bool = True) -> Column:
    return kind.isin(*BY_REF_KINDS, *(["chan"] if container_writes else []))


def null_wrapper(package: Column, name: Column) -> Column:
    out = (package == "database/sql") & name.startswith("Null")
    for m in NULL_WRAPPER_MODULES:
        out = out | (package == m) | package.startswith(m + "/") | package.startswith(m + ".")
    return out


def kafka_package(package: Column) -> Column:
    return package.isin(*KAFKA_PACKAGES)


def grpc_client(package_path: Column, package_name: Column, type_name: Column, method: Column, segs: Sequence[str] = PB_SEGMENTS) -> Column:
    """The contract that a call on a generated client serves; null if it is none."""
    service = F.regexp_replace(type_name, "Client$", "")
    ok = type_name.endswith("Client") & (type_name != "Client") & ~service.contains("_") & pb_match(package_path, segs)
    return F.when(ok, F.concat(package_name, F.lit("."), service, F.lit("/"), method))


def stream_port(package_path: Column, package_name: Column, type_name: Column, method: Column, segs: Sequence[str] = PB_SEGMENTS) -> Column:
    """struct(contract, op, client_side) of a data method of a generated stream; null if it is none."""
    stem = F.regexp_replace(type_name, "(Server|Client)$", "")
    service = F.substring_index(stem, "_", 1)
    rpc = F.substring(stem, F.length(service) + 2, F.length(stem))
    op = F.when(method.isin(*SEND_METHODS), "SEND").when(method.isin(*RECV_METHODS), "RECV")
    ok = type_name.rlike("(Server|Client)$") & stem.contains("_") & (service != "") & (rpc != "") & op.isNotNull() & pb_match(package_path, segs)
    return F.when(ok, F.struct(F.concat(package_name, F.lit("."), service, F.lit("/"), rpc).alias("contract"), op.alias("op"), type_name.endswith("Client").alias("client_side")))


def grpc_shaped(last_param: Column, variadic: Column) -> Column:
    return variadic & last_param.rlike(r"^\[\]([^ ]*/)?grpc\.CallOption$")


def server_embed(type_name: Column) -> Column:
    """The service whose server a struct embeds; empty if none."""
    return F.regexp_extract(type_name, "^(?:Unimplemented|Unsafe)(.+)Server$", 1)


def grpc_server_type(type_name: Column) -> Column:
    return type_name.rlike("^Unimplemented.*Server$")


def handler_kind(params: Column, results: Column, method: Column, service: Column, stream_has_send: Column) -> Column:
    """unary, server, client, bidi or none, from arrays of type strings."""
    n = F.size(params)
    first, last = F.try_element_at(params, F.lit(1)), F.try_element_at(params, F.lit(-1))
    stream = F.regexp_extract(last, r"([^./]+)$", 1) == F.concat(service, F.lit("_"), method, F.lit("Server"))
    ok = n.between(1, 2) & (F.size(results) == 1) & (F.try_element_at(results, F.lit(1)) == "error") & stream
    return F.when((n >= 1) & first.endswith("context.Context"), "unary").when(~F.coalesce(ok, F.lit(False)), "none").when(n == 2, "server").when(stream_has_send, "bidi").otherwise("client")


def resolver_args(params: Column, type_name: Column) -> Column:
    """Indices of a resolver's untrusted parameters: after the context, and after the parent object unless it is a root."""
    start = F.when(type_name.isin(*ROOT_TYPES), 1).otherwise(2)
    ok = F.coalesce(F.try_element_at(params, F.lit(1)).endswith("context.Context"), F.lit(False)) & (start < F.size(params))
    return F.when(ok, F.sequence(start, F.size(params) - 1)).otherwise(F.array().cast("array<int>"))


def signature_shape(signature: Column) -> Column:
    """``func(w T, r U) R`` without the parameters' names."""
    inside = F.regexp_extract(signature, r"^func\(([^)]*)\)", 1)
    types = F.array_join(F.transform(F.split(inside, ", "), lambda p: F.regexp_replace(p, r"^[^ ]+ ", "")), ", ")
    return F.concat(F.lit("func("), types, F.lit(")"), F.regexp_replace(signature, r"^func\([^)]*\)", ""))


def usable_target(emitted: Column, synthetic: Column, is_instance: Column, has_body: Column, keep_known: bool = True) -> Column:
    """Whether dispatch may name a function: if it is emitted; without that list, bodyless and synthetic ones are refused."""
    return emitted if keep_known else has_body & ((F.coalesce(synthetic, F.lit("")) == "") | is_instance)


def instance_like(type_args: Column) -> Column:
    return F.coalesce(F.size(type_args) > 0, F.lit(False))
