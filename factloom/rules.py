"""What is known of libraries, as small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Import paths.
NET_HTTP = ("net/http",)
CHI = ("github.com/go-chi/chi/v5", "github.com/go-chi/chi")
GIN = ("github.com/gin-gonic/gin",)
ECHO = ("github.com/labstack/echo/v4",)
GORILLA = ("github.com/gorilla/mux",)
KAFKA_GO = ("github.com/segmentio/kafka-go",)
SARAMA = ("github.com/IBM/sarama", "github.com/Shopify/sarama")
FRANZ = ("github.com/twmb/franz-go/pkg/kgo",)

# What router calls do. Framework, packages, receivers (none: a package function), names, operation, then the
# method ("" = by argument or pattern) and what differs from none: method_arg, methods_arg, path_arg, handler_arg, fn_arg, flags.
_CHI, _GIN, _ECHO, _MUX, _ROUTE = ("Mux", "Router"), ("Engine", "RouterGroup", "IRouter", "IRoutes"), ("Echo", "Group"), ("Router",), ("Route",)
_NINE = ("Get", "Post", "Put", "Patch", "Delete", "Head", "Options", "Connect", "Trace")
ROUTER_CALLS = [
    ("net/http", NET_HTTP, (), ("NewServeMux",), "new", "", {}),
    ("net/http", NET_HTTP, ("ServeMux",), ("Handle", "HandleFunc"), "route", "", {"path_arg": 0, "handler_arg": 1, "pattern_method": True}),
    ("net/http", NET_HTTP, (), ("Handle", "HandleFunc"), "route", "", {"path_arg": 0, "handler_arg": 1, "pattern_method": True, "default_mux": True}),
    ("net/http", NET_HTTP, (), ("StripPrefix",), "strip", "", {"path_arg": 0, "handler_arg": 1}),
    ("chi", CHI, (), ("NewRouter", "NewMux"), "new", "", {}),
    ("chi", CHI, _CHI, _NINE, "route", "=", {"path_arg": 0, "handler_arg": 1}),
    ("chi", CHI, _CHI, ("Handle", "HandleFunc"), "route", "*", {"path_arg": 0, "handler_arg": 1}),
    ("chi", CHI, _CHI, ("Method", "MethodFunc"), "route", "", {"method_arg": 0, "path_arg": 1, "handler_arg": 2}),
    ("chi", CHI, _CHI, ("Route",), "sub", "", {"path_arg": 0, "fn_arg": 1}),
    ("chi", CHI, _CHI, ("Group",), "sub", "", {"fn_arg": 0}),
    ("chi", CHI, _CHI, ("With",), "same", "", {}),
    ("chi", CHI, _CHI, ("Mount",), "mount", "", {"path_arg": 0, "handler_arg": 1}),
    ("gin", GIN, (), ("New", "Default"), "new", "", {}),
    ("gin", GIN, _GIN, ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"), "route", "=", {"path_arg": 0, "handler_arg": 1, "last_handler": True}),
    ("gin", GIN, _GIN, ("Any",), "route", "*", {"path_arg": 0, "handler_arg": 1, "last_handler": True}),
    ("gin", GIN, _GIN, ("Handle",), "route", "", {"method_arg": 0, "path_arg": 1, "handler_arg": 2, "last_handler": True}),
    ("gin", GIN, _GIN, ("Match",), "route", "", {"methods_arg": 0, "path_arg": 1, "handler_arg": 2, "last_handler": True}),
    ("gin", GIN, _GIN, ("Group",), "group", "", {"path_arg": 0}),
    ("gin", GIN, _GIN, ("Use",), "same", "", {}),
    ("echo", ECHO, (), ("New",), "new", "", {}),
    ("echo", ECHO, _ECHO, ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE"), "route", "=", {"path_arg": 0, "handler_arg": 1}),
    ("echo", ECHO, _ECHO, ("Any",), "route", "*", {"path_arg": 0, "handler_arg": 1}),
    ("echo", ECHO, _ECHO, ("Add",), "route", "", {"method_arg": 0, "path_arg": 1, "handler_arg": 2}),
    ("echo", ECHO, _ECHO, ("Match",), "route", "", {"methods_arg": 0, "path_arg": 1, "handler_arg": 2}),
    ("echo", ECHO, _ECHO, ("Group",), "group", "", {"path_arg": 0}),
    ("gorilla", GORILLA, (), ("NewRouter",), "new", "", {}),
    ("gorilla", GORILLA, _MUX, ("HandleFunc", "Handle"), "route", "*", {"path_arg": 0, "handler_arg": 1, "route_chain": True}),
    ("gorilla", GORILLA, _ROUTE, ("HandlerFunc", "Handler"), "route", "*", {"handler_arg": 0, "route_chain": True}),
    ("gorilla", GORILLA, _MUX + _ROUTE, ("PathPrefix", "Path"), "group", "", {"path_arg": 0}),
    ("gorilla", GORILLA, _MUX + _ROUTE, ("Methods",), "same", "", {"methods_arg": 0}),
    ("gorilla", GORILLA, _MUX + _ROUTE, ("NewRoute", "Subrouter", "Schemes", "Host", "Headers", "Queries", "Name", "MatcherFunc"), "same", "", {}),
]
# Parameter types that carry a request, and the function types of handlers.
REQUEST_TYPES = [(NET_HTTP, "Request"), (GIN, "Context"), (ECHO, "Context")]
HANDLER_SHAPES = ["func(net/http.ResponseWriter, *net/http.Request)", "func(*github.com/gin-gonic/gin.Context)", "func(github.com/labstack/echo/v4.Context) error"]
# Client calls. Receiver, name, method ("" = by argument), method_arg, url_arg, data_args.
CLIENT_CALLS = [
    *[(recv, *c) for recv in ("", "Client") for c in (("Get", "GET", -1, 0, [0]), ("Head", "HEAD", -1, 0, [0]), ("Post", "POST", -1, 0, [0, 2]), ("PostForm", "POST", -1, 0, [0, 1]))],
    ("", "NewRequest", "", 0, 1, [1, 2]),
    ("", "NewRequestWithContext", "", 1, 2, [2, 3]),
]
# Untrusted fields of a request, and where outgoing requests come from.
SURFACE_FIELDS = [("net/http", "Request", f) for f in ("Body", "Form", "PostForm", "MultipartForm", "Header", "Trailer", "URL", "Host", "RequestURI")]
OUTGOING_CALLS, DERIVING_METHODS, RESPONSE_FIELD = ("NewRequest", "NewRequestWithContext"), ("Clone", "WithContext"), ("net/http", "Response", "Request")
# Payload fields of messages.
PAYLOADS = [(KAFKA_GO, "Message", "Value"), (SARAMA, "ProducerMessage", "Value"), (SARAMA, "ConsumerMessage", "Value"), (FRANZ, "Record", "Value")]
# Topic calls. Library, packages, receiver, names, role, payload_arg, several payloads, where the topic stands on
# the handle, on the message, whether the handle decides, constructors (packages, receiver, name, argument, field, list field, options).
TOPIC_CALLS = [
    ("kafka-go", KAFKA_GO, "Writer", ("WriteMessages",), "produce", 1, True, "Topic", "Topic", True, [(KAFKA_GO, "", "NewWriter", 0, "Topic", "", "")]),
    ("kafka-go", KAFKA_GO, "Reader", ("ReadMessage", "FetchMessage"), "consume", -1, False, "", "", False, [(KAFKA_GO, "", "NewReader", 0, "Topic", "GroupTopics", "")]),
    ("sarama", SARAMA, "SyncProducer", ("SendMessage",), "produce", 0, False, "", "Topic", False, []),
    ("sarama", SARAMA, "SyncProducer", ("SendMessages",), "produce", 0, True, "", "Topic", False, []),
    ("sarama", SARAMA, "PartitionConsumer", ("Messages",), "receive", -1, False, "", "", False, [(SARAMA, "Consumer", "ConsumePartition", 0, "", "", "")]),
    ("sarama", SARAMA, "ConsumerGroup", ("Consume",), "bind", -1, False, "", "", False, []),
    ("sarama", SARAMA, "AsyncProducer", ("Input",), "send", -1, False, "", "Topic", False, []),
    ("franz-go", FRANZ, "Client", ("Produce", "TryProduce"), "produce", 1, False, "", "Topic", False, [(FRANZ, "", "NewClient", 0, "", "", "DefaultProduceTopic")]),
    ("franz-go", FRANZ, "Client", ("ProduceSync",), "produce", 1, True, "", "Topic", False, [(FRANZ, "", "NewClient", 0, "", "", "DefaultProduceTopic")]),
    ("franz-go", FRANZ, "Client", ("PollFetches", "PollRecords"), "consume", -1, False, "", "", False, [(FRANZ, "", "NewClient", 0, "", "", "ConsumeTopics")]),
    ("franz-go", FRANZ, "Fetches", ("EachRecord",), "each", -1, False, "", "", False, [(FRANZ, "", "NewClient", 0, "", "", "ConsumeTopics")]),
]
#: The handler method that a consumer group calls.
CALLBACK_METHOD = "ConsumeClaim"


def router_rules(spark: SparkSession) -> DataFrame:
    """One row per package, receiver and name, with the number of the rule it comes from; the first rule that fits wins."""
    rows = []
    for order, (framework, packages, receivers, names, op, method, how) in enumerate(ROUTER_CALLS):
        arg = {k: how.get(k, -1) for k in ("method_arg", "methods_arg", "path_arg", "handler_arg", "fn_arg")}
        flag = {k: how.get(k, False) for k in ("last_handler", "pattern_method", "default_mux", "route_chain")}
        for p in packages:
            for r in receivers or ("",):
                rows += [(order, framework, p, r, n, op, n.upper() if method == "=" else method, *arg.values(), *flag.values()) for n in names]
    spec = "rule_ord int, framework string, pkg string, recv string, name string, op string, method string, method_arg int, methods_arg int, path_arg int, handler_arg int, fn_arg int, last_handler boolean, pattern_method boolean, default_mux boolean, route_chain boolean"
    return spark.createDataFrame(rows, spec)


def client_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, "net/http", *c) for k, c in enumerate(CLIENT_CALLS)]
    return spark.createDataFrame(rows, "rule_ord int, pkg string, recv string, name string, method string, method_arg int, url_arg int, data_args array<int>")


def topic_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, lib, p, recv, n, role, payload, several, handle, message, decides) for k, (lib, packages, recv, names, role, payload, several, handle, message, decides, _) in enumerate(TOPIC_CALLS) for p in packages for n in names]
    return spark.createDataFrame(rows, "rule_ord int, library string, pkg string, recv string, name string, role string, payload_arg int, several boolean, handle_field string, message_field string, handle_decides boolean")


def constructor_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, p, recv, name, arg, field, many, option) for k, call in enumerate(TOPIC_CALLS) for packages, recv, name, arg, field, many, option in call[-1] for p in packages]
    return spark.createDataFrame(rows, "rule_ord int, pkg string, recv string, name string, arg int, field string, list_field string, option string")


def router_types(spark: SparkSession) -> DataFrame:
    """Types of router values, with the handler interface by which routers travel."""
    rows = {(p, r) for _, packages, receivers, *_ in ROUTER_CALLS for p in packages for r in receivers} | {("net/http", "Handler")}
    return spark.createDataFrame(sorted(rows), "pkg string, name string")


def request_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n) for packages, n in REQUEST_TYPES for p in packages], "pkg string, name string")


def surface_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SURFACE_FIELDS, "pkg string, name string, field string")


def payload_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n, f) for packages, n, f in PAYLOADS for p in packages], "pkg string, name string, field string")
