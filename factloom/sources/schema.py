"""Schemas: the tables that describe a program (input) and the package facts (output).

A message is a list of (number, name, type, repeated). A type is a scalar, ``enum:Name`` or another message's name. The Spark
schemas are derived from these lists.
"""

from __future__ import annotations

# Names of enum members by number.
ENUMS = {
    "Origin": ("USER", "STDLIB", "DEP"),
    "Generator": ("NONE", "PROTOC", "GQLGEN", "MOCKGEN"),
    "TypeKind": ("STRUCT", "INTERFACE", "ALIAS"),
    "VertexKind": ("IN_PARAM", "IN_RECEIVER", "IN_GLOBAL", "OUT_RETURN", "OUT_PARAM_BYREF", "OUT_FIELD", "CALL_ARG_PORT", "CALL_RESULT_PORT", "OUT_RECEIVER_BYREF"),
    "SiteKind": ("STATIC", "VIRTUAL", "INVOKES_REMOTE", "GO", "DEFER", "BUILTIN"),
    "StreamOp": ("NONE", "SEND", "RECV"),
    "EndpointKind": ("GRPC", "GRAPHQL", "HTTP", "MESSAGE"),
}
# The wire format of package facts, schema version 3.
SCHEMA_VERSION = 3
MESSAGES = {
    "Package": [
        (1, "repo", "string", False), (2, "commit_sha", "string", False), (3, "package_path", "string", False), (4, "schema_version", "int32", False), (5, "language", "string", False),
        (10, "functions", "Function", True), (11, "types", "Type", True), (12, "proto_messages", "ProtoMessage", True), (13, "grpc_methods", "GrpcMethod", True),
        (14, "graphql_fields", "GraphqlField", True), (15, "endpoints", "Endpoint", True), (16, "http_routes", "HttpRoute", True),
    ],
    "Ident": [(1, "iid", "bytes", False), (2, "bid", "bytes", False)],
    "Span": [(1, "file", "string", False), (2, "line", "int32", False), (3, "col", "int32", False)],
    "Function": [
        (1, "id", "Ident", False), (2, "fqn", "string", False), (3, "package", "string", False), (4, "origin", "enum:Origin", False), (5, "generated", "bool", False),
        (6, "generator", "enum:Generator", False), (7, "has_body", "bool", False), (8, "span", "Span", False), (9, "signature", "Signature", False), (10, "flow", "LocalFlow", False),
        (11, "binds_to", "bytes", True), (12, "source_params", "uint32", True),
    ],
    "Signature": [(1, "params", "Param", True), (2, "has_receiver", "bool", False), (3, "returns", "TypeRef", True), (4, "variadic", "bool", False)],
    "Param": [(1, "name", "string", False), (2, "type", "string", False), (3, "by_ref", "bool", False)],
    "TypeRef": [(1, "type", "string", False)],
    "Type": [(1, "fqn", "string", False), (2, "kind", "enum:TypeKind", False), (3, "implements", "bytes", True), (4, "fields", "Field", True)],
    "Field": [(1, "index", "uint32", False), (2, "name", "string", False), (3, "type", "string", False)],
    "LocalFlow": [(1, "vertices", "FlowVertex", True), (2, "edges", "FlowEdge", True), (3, "callsites", "CallSite", True)],
    "FlowVertex": [
        (1, "id", "uint32", False), (2, "kind", "enum:VertexKind", False), (3, "index", "uint32", False), (4, "field_path", "uint32", True), (5, "callsite_id", "uint32", False), (6, "sym", "bytes", False),
        (7, "type", "string", False), (8, "span", "Span", False), (9, "field_names", "string", True), (10, "sym_name", "string", False), (11, "iface_type", "bytes", False),
    ],
    "FlowEdge": [(1, "src", "uint32", False), (2, "dst", "uint32", False), (3, "via_alias", "bool", False)],
    "CallSite": [
        (1, "id", "uint32", False), (2, "kind", "enum:SiteKind", False), (3, "callee_iids", "bytes", True), (4, "opaque", "bool", False), (5, "callee_fqn", "string", False), (6, "argc", "uint32", False),
        (7, "arg0_is_receiver", "bool", False), (8, "resultc", "uint32", False), (9, "span", "Span", False), (10, "dispatch_confidence", "float", False), (11, "stream_op", "enum:StreamOp", False),
        (12, "stream_client_side", "bool", False), (13, "error_results", "uint64", False), (14, "arg_names", "string", True), (15, "http_call", "HttpCall", False), (16, "target_fqns", "string", True),
    ],
    "HttpCall": [(1, "method", "string", False), (2, "path", "string", False)],
    "ProtoMessage": [(1, "full_name", "string", False), (2, "fields", "ProtoField", True)],
    "ProtoField": [(1, "index", "uint32", False), (2, "name", "string", False), (3, "type", "string", False), (4, "pii", "PiiTag", True)],
    "PiiTag": [(1, "category", "string", False)],
    "GrpcMethod": [
        (1, "iid", "bytes", False), (2, "full_name", "string", False), (3, "input_msg", "string", False), (4, "output_msg", "string", False), (5, "handler_iid", "bytes", False),
        (6, "endpoint_iid", "bytes", False), (7, "client_streaming", "bool", False), (8, "server_streaming", "bool", False),
    ],
    "GraphqlField": [(1, "iid", "bytes", False), (2, "type_field", "string", False), (3, "resolver_iid", "bytes", False), (4, "endpoint_iid", "bytes", False), (5, "args", "GraphqlArg", True)],
    "GraphqlArg": [(1, "name", "string", False), (2, "param_idx", "uint32", False)],
    "HttpRoute": [
        (1, "iid", "bytes", False), (2, "method", "string", False), (3, "path", "string", False), (4, "display", "string", False), (5, "handler_iid", "bytes", False), (6, "endpoint_iid", "bytes", False),
        (7, "request_params", "uint32", True), (8, "framework", "string", False),
    ],
    "Endpoint": [(1, "iid", "bytes", False), (2, "kind", "enum:EndpointKind", False), (3, "untrusted_input", "bool", False), (4, "name", "string", False)],
}

_SCALARS = {"string": "string", "bytes": "binary", "int32": "int", "uint32": "int", "uint64": "bigint", "bool": "boolean", "float": "float"}


def ddl(message: str) -> str:
    """The columns of a message as Spark DDL; enums are their members' names, absent messages null."""

    def kind(t: str) -> str:
        if t.startswith("enum:"):
            return "string"
        return _SCALARS.get(t) or f"struct<{', '.join(f'{n}: {column(u, r)}' for _, n, u, r in MESSAGES[t])}>"

    def column(t: str, repeated: bool) -> str:
        return f"array<{kind(t)}>" if repeated else kind(t)

    return ", ".join(f"{n} {column(t, r)}" for _, n, t, r in MESSAGES[message])


#: The tables that describe a built program.
PROGRAM = {
    "pkg": "pkg_path string, name string, module_path string, in_scope boolean, n_errors int, has_ssa boolean",
    "pkg_error": "pkg_path string, message string",
    "src_file": "pkg_path string, file string, header_comments array<string>, is_test boolean",
    "type": "type_key string, pkg_path string, name string, kind string, elem string, alias_of string, n_type_params int",
    "field": "type_key string, idx int, name string, ftype string, tag string, embedded boolean",
    "method": "type_key string, method_id string, name string, sig string, in_value_set boolean, decl_fn string",
    "iface_method": "iface_key string, method_id string, name string, sig string",
    "func": "fn string, pkg_path string, parent_fn string, fqn string, signature string, recv_type string, has_body boolean, synthetic string, type_args array<string>, file string, line int, col int",
    "param": "fn string, idx int, value string, type string",
    "free_var": "fn string, idx int, value string, type string",
    "instr": "fn string, block int, ord int, op string, value string, type string, field_idx int, aux string",
    "operand": "fn string, block int, ord int, pos int, value string",
    "const": "value string, kind string, literal string",
    "call": "fn string, block int, ord int, kind string, is_invoke boolean, iface_type string, method string, static_callee string, func_value string, is_builtin boolean",
    "cg_edge": "caller string, block int, ord int, callee string",
    "git_commit": "commit_sha string, parent_sha string, dirty boolean",
    "git_diff": "base string, head string, file string",
}
