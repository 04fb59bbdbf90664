"""The library's operators bound to the driver's tables, each with the SQL that checks it.

A call site is an order, its targets are the suppliers of its lines, its function's package the customer, its repository the
customer's nation; a cell is an event type with writers and readers by event; templates are page URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, ident, paths
from .functions import strings as S
from .operators import census, dispatch, externals, flow, links, routes, satisfaction, signatures
from .plans import fixpoint

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sites(spark, d, cap=dispatch.CAP) -> DataFrame:
    return dispatch.targets_at(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey", cap)


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- dispatch and statistics ----

_SITES = """SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS t, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey"""


def _sites_sql(cap: int) -> str:
    return f"""SELECT l_orderkey, CASE WHEN n <= {cap} THEN array_to_string(t, ',') ELSE '' END AS targets, least(n, {cap + 1})::INT AS n_targets,
      n > {cap} AS capped, n > {cap} AS opaque, CASE WHEN n BETWEEN 2 AND {cap} THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END AS confidence FROM ({_SITES})"""


@query(_sites_sql(10))
def dispatch_targets(spark, d):
    return _sites(spark, d).withColumn("targets", _text("targets"))


@query(_sites_sql(4))
def dispatch_targets_cap4(spark, d):
    return _sites(spark, d, 4).withColumn("targets", _text("targets"))


@query(f"SELECT (CASE WHEN n <= 10 THEN n ELSE 0 END)::INT AS fanout, count(*) AS sites FROM ({_SITES}) GROUP BY 1")
def fanout_hist(spark, d):
    return census.fanout_histogram(_sites(spark, d), "targets")


@query(f"SELECT printf('%.4f', CASE WHEN n BETWEEN 2 AND 10 THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END) AS confidence, count(*) AS sites FROM ({_SITES}) GROUP BY 1")
def confidence_hist(spark, d):
    return census.confidence_histogram(_sites(spark, d), "confidence")


@query(
    f"""SELECT count(DISTINCT c_nationkey) AS shards, count(DISTINCT o_custkey) AS functions, count(*) AS sites, count(*) FILTER (WHERE n > 10) AS opaque
    FROM ({_SITES}) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
)
def stat_totals(spark, d):
    sites = _sites(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return census.totals(sites, "c_nationkey", "o_custkey", "opaque")


@query(
    f"""SELECT l_orderkey, concat_ws(chr(9), o_custkey, l_orderkey, n > 10, printf('%.4f', CASE WHEN n BETWEEN 2 AND 10 THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END),
      CASE WHEN n <= 10 THEN array_to_string(t, ',') ELSE '' END) AS line FROM ({_SITES}) JOIN orders ON l_orderkey = o_orderkey"""
)
def sites_tsv(spark, d):
    s = _sites(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return s.select("l_orderkey", F.concat_ws("\t", F.col("o_custkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("opaque").cast("string"), F.format_string("%.4f", F.col("confidence")), _text("targets")).alias("line"))


def _resolution(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    emitted = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("static_emitted"))
    owner = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("static_owner"))
    sites = line.join(emitted, "l_suppkey", "left").join(owner, "l_partkey", "left")
    sites = sites.withColumn("remote", F.when(F.col("l_returnflag") == "R", F.concat(F.lit("r"), F.col("l_suppkey").cast("string")))).withColumn("dispatch", F.when(F.col("l_linenumber") <= 2, F.array(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")))))
    return dispatch.resolve_callees(sites.withColumn("placeholder", F.concat(F.lit("name:"), F.col("l_partkey").cast("string"))))


_RESOLVED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 'r' || l_suppkey WHEN s_suppkey IS NOT NULL THEN 's' || l_suppkey WHEN p_partkey IS NOT NULL THEN 'p' || l_partkey WHEN l_linenumber <= 2 THEN 'd' || l_linenumber ELSE 'name:' || l_partkey END AS callee,
  CASE WHEN l_returnflag = 'R' THEN 'remote' WHEN s_suppkey IS NOT NULL THEN 'static' WHEN p_partkey IS NOT NULL THEN 'external' WHEN l_linenumber <= 2 THEN 'dispatch' ELSE 'name' END AS resolved_by
  FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON l_partkey = p_partkey"""


@query(_RESOLVED)
def callee_resolution(spark, d):
    return _resolution(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at("callees", 1).alias("callee"), "resolved_by")


@query(f"SELECT count(*) AS sites, count(*) FILTER (WHERE resolved_by = 'name') AS unresolved, count(*) FILTER (WHERE resolved_by = 'external') AS external, count(*) FILTER (WHERE resolved_by = 'remote') AS remote FROM ({_RESOLVED})")
def site_census(spark, d):
    by = F.col("resolved_by")
    return census.site_census(_resolution(spark, d), unresolved=by == "name", external=by == "external", remote=by == "remote")


@query(
    """SELECT l_orderkey, array_to_string(CASE WHEN len(own) > 10 THEN [] WHEN len(u) <= 10 THEN list_sort(u) ELSE list_sort(own) END, ',') AS targets FROM (
      SELECT l_orderkey, coalesce(list(DISTINCT 's' || l_suppkey) FILTER (WHERE l_returnflag <> 'R'), []) AS own, list(DISTINCT 's' || l_suppkey) AS u
      FROM lineitem GROUP BY l_orderkey)"""
)
def external_targets(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("t"), "l_returnflag")
    per = lambda x: x.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("t")).alias("targets"))
    own = dispatch.targets_at(line.where("l_returnflag <> 'R'"), ["l_orderkey"], "t")
    outside = per(line.where("l_returnflag = 'R'")).join(own.where("capped").select("l_orderkey"), "l_orderkey", "left_anti")
    return dispatch.with_externals(own, outside, ["l_orderkey"]).withColumn("targets", _text("targets"))


@query(
    """SELECT sum(lost)::BIGINT AS edges, count(*) FILTER (WHERE lost > 0 AND kept = 0) AS sites_all_lost, count(*) FILTER (WHERE lost > 0 AND kept > 0) AS sites_some_lost FROM (
    SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus <> 'F') AS lost, count(*) FILTER (WHERE l_linestatus = 'F') AS kept FROM lineitem GROUP BY 1)"""
)
def dropped_generics(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("generic"), (F.col("l_linestatus") == "F").alias("kept"))
    return dispatch.dropped_generics(line, ["l_orderkey"], "generic", "kept")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS ordinal FROM lineitem")
def call_ordinal(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dispatch.ordinals(line, "l_orderkey", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


# ---- identities ----


def _framed_sql(x: str) -> str:
    n = f"octet_length(encode({x}))"
    return f"unhex(printf('%02x%02x%02x%02x00000000', {n} % 256, {n} // 256 % 256, {n} // 65536 % 256, {n} // 16777216)) || encode({x})"


def _digest_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(f) for f in fields) + ")"


@query(f"SELECT page_id, {_digest_sql("'repo'", "'pkg'", 'url', "''")} AS iid FROM pages")
def iid_pages(spark, d):
    return table(spark, d, "pages").select("page_id", ident.iid("repo", "pkg", F.col("url"), "").alias("iid"))


@query(f"SELECT p_partkey, {_digest_sql("''", "''", "'http:GET /' || p_name", "'http'")} AS iid FROM part")
def contract_iid(spark, d):
    return table(spark, d, "part").select("p_partkey", ident.contract_iid(paths.contract_name(F.lit("GET"), F.concat(F.lit("/"), F.col("p_name"))), "http").alias("iid"))


@query(f"SELECT c_custkey, {_digest_sql("CASE WHEN c_acctbal > 0 THEN n_name ELSE 'repo' END", 'c_mktsegment', 'c_name', "'func()'")} AS iid FROM customer JOIN nation ON c_nationkey = n_nationkey")
def owner_iid(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    module = F.when(F.col("c_acctbal") > 0, F.col("n_name")).otherwise("")
    return c.select("c_custkey", ident.iid(ident.owner(module, F.lit("repo")), F.col("c_mktsegment"), F.col("c_name"), "func()").alias("iid"))


@query(
    f"""SELECT o_orderkey, sha256(unhex(hex({_framed_sql("o_orderstatus || '|' || o_orderpriority")}) || coalesce(c, ''))) AS bid FROM orders LEFT JOIN (
      SELECT l_orderkey, string_agg(hex({_framed_sql("'s' || l_suppkey")}), '' ORDER BY encode('s' || l_suppkey)) AS c FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
)
def body_id(spark, d):
    callees = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).cast("binary")).alias("c"))
    o = table(spark, d, "orders").join(callees, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", ident.body_id(body, F.coalesce("c", F.array().cast("array<binary>"))).alias("bid"))


@query("SELECT o_custkey, sha256(unhex(string_agg(h, '' ORDER BY h))) AS set_hash FROM (SELECT o_custkey, sha256(encode(o_orderkey::VARCHAR)) AS h FROM orders) GROUP BY o_custkey")
def fn_set_hash(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.unhex(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)).alias("h"))
    return o.groupBy("o_custkey").agg(ident.set_digest(F.sort_array(F.collect_list("h"))).alias("set_hash"))


# ---- paths and names ----

_REWRITE = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '[0-9]+', '{id}') WHEN 2 THEN regexp_replace(url, '/[0-9]+', '/:id') WHEN 3 THEN regexp_replace(url, '/[0-9]+', '/*rest')
  WHEN 4 THEN regexp_replace(url, '[0-9]+', '{p...}') WHEN 5 THEN regexp_replace(url, '[0-9]+', '[id]') WHEN 6 THEN url || '/{$}' ELSE url || '?q={}#f' END"""


def _templates(spark, d) -> DataFrame:
    first = lambda pattern, by: F.regexp_replace(F.col("url"), f"^(.*?){pattern}", "$1" + by)
    k = F.col("page_id") % 8
    t = F.when(k == 0, F.col("url")).when(k == 1, first("[0-9]+", "{id}")).when(k == 2, first("/[0-9]+", "/:id")).when(k == 3, first("/[0-9]+", "/*rest")).when(k == 4, first("[0-9]+", "{p...}")).when(k == 5, first("[0-9]+", "[id]"))
    return table(spark, d, "pages").select("page_id", t.when(k == 6, F.concat("url", F.lit("/{$}"))).otherwise(F.concat("url", F.lit("?q={}#f"))).alias("t"))


def _canon_sql(x: str) -> str:
    return f"""'/' || array_to_string((lambda s: CASE WHEN list_position(s, '{{*}}') > 0 THEN s[1:list_position(s, '{{*}}')] ELSE s END)(list_filter(list_transform(
      string_split(regexp_replace(regexp_replace({x}, '(?i)^(https?:)?//[^/]*', ''), '(?s)[?#].*$', ''), '/'), lambda g: CASE WHEN g = '{{$}}' THEN '' WHEN starts_with(g, '*') OR g = '{{*}}'
      OR (starts_with(g, '{{') AND ends_with(g, '...}}')) OR ((starts_with(g, '[...') OR starts_with(g, '[[...')) AND ends_with(g, ']')) THEN '{{*}}'
      WHEN contains(g, '{{') OR contains(g, '[') OR starts_with(g, ':') THEN '{{}}' ELSE g END), lambda g: g <> '')), '/')"""


def _canon_query(source: str, x: str, columns: str) -> str:
    inner = _canon_sql(x)
    # DuckDB calls no lambda directly, so the segments are named in a subquery
    segments = inner[inner.index("(list_filter(") + 1 : -len("), '/')")]
    return f"SELECT {columns}, '/' || array_to_string(CASE WHEN list_position(s, '{{*}}') > 0 THEN s[1:list_position(s, '{{*}}')] ELSE s END, '/') AS path FROM (SELECT *, {segments} AS s FROM ({source}))"


_CANON = _canon_query(f"SELECT page_id, {_REWRITE} AS t FROM pages", "t", "page_id")


@query(_CANON)
def canon_path(spark, d):
    return _templates(spark, d).select("page_id", paths.canon_path(F.col("t")).alias("path"))


@query(f"SELECT page_id, 'http:' || m || ' ' || path AS name, {_digest_sql("''", "''", "'http:' || m || ' ' || path", "'http'")} AS iid FROM ({_CANON}), (VALUES ('GET'), ('POST'), ('*')) v(m)")
def http_routes_from_pages(spark, d):
    routes = _templates(spark, d).select("page_id", paths.canon_path(F.col("t")).alias("path"), F.explode(F.array(F.lit("GET"), F.lit("POST"), F.lit("*"))).alias("m"))
    named = routes.select("page_id", paths.contract_name(F.col("m"), F.col("path")).alias("name"))
    return named.withColumn("iid", ident.contract_iid(F.col("name"), "http"))


_PATTERNS = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'GET /' || p_name WHEN 1 THEN 'POST  example.com/' || p_name || '/' WHEN 2 THEN '/' || p_name || '/' WHEN 3 THEN p_name ELSE '{}/' || p_name END AS p FROM part"""


def _patterns(spark, d) -> DataFrame:
    k, n = F.col("p_size") % 5, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    p = F.when(k == 0, F.concat(F.lit("GET /"), n)).when(k == 1, F.concat(F.lit("POST  example.com/"), n, F.lit("/"))).when(k == 2, F.concat(F.lit("/"), n, F.lit("/"))).when(k == 3, n).otherwise(F.concat(F.lit("{}/"), n))
    return table(spark, d, "part").select("p_partkey", "p_size", p.alias("p"))


_N = "replace(p_name, ' ', '-')"


@query(
    f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS method,
    CASE p_size % 5 WHEN 0 THEN '/' || {_N} WHEN 1 THEN '/' || {_N} || '/' WHEN 2 THEN '/' || {_N} || '/' WHEN 3 THEN '' ELSE '{{}}/' || {_N} END AS path,
    CASE p_size % 5 WHEN 0 THEN '/' || {_N} WHEN 1 THEN '/' || {_N} || '/{{*}}' WHEN 2 THEN '/' || {_N} || '/{{*}}' WHEN 3 THEN '' ELSE '{{}}/' || {_N} END AS subtree FROM part"""
)
def split_pattern(spark, d):
    p = F.col("p")
    return _patterns(spark, d).select("p_partkey", paths.pattern_method(p).alias("method"), paths.pattern_path(p).alias("path"), paths.subtree(paths.pattern_path(p)).alias("subtree"))


@query("SELECT page_id, CASE WHEN ends_with(url, '/') THEN url || '{*}' ELSE url END AS subtree, CASE WHEN starts_with(regexp_replace(url, '/{2,}', '/', 'g'), '/') THEN regexp_replace(url, '/{2,}', '/', 'g') ELSE '/' || regexp_replace(url, '/{2,}', '/', 'g') END AS display FROM pages")
def subtree(spark, d):
    return table(spark, d, "pages").select("page_id", paths.subtree(F.col("url")).alias("subtree"), paths.display(F.col("url")).alias("display"))


@query("SELECT p_partkey, '/' || p_brand || '/{}?n={}&p=100%' AS a, '{}' || p_type || '{}' AS b FROM part")
def sprintf_template(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", paths.sprintf_template(F.concat(F.lit("/"), "p_brand", F.lit("/%s?n=%[1]d&p=100%%"))).alias("a"), paths.sprintf_template(F.concat(F.lit("%s%d"), "p_type", F.lit("%"))).alias("b"))


@query("SELECT n_nationkey, lower(n_name[1:5]) || n_name[6:] AS whole, 'id' || lower(n_name) AS mixed, lower(n_name[1]) || lower(n_name[2:]) AS first FROM nation")
def lcfirst(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", paths.lcfirst(F.col("n_name")).alias("whole"), paths.lcfirst(F.concat(F.lit("ID"), F.initcap("n_name"))).alias("__m"), F.lower("n_name").alias("__l"), paths.lcfirst(F.concat(F.upper(F.left("n_name", F.lit(1))), F.lower(F.substring("n_name", 2, 100)))).alias("first")).select("n_nationkey", "whole", F.lower("__m").alias("mixed"), "first")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/' || p_brand || '/users' WHEN p_size % 3 = 1 THEN '/' || p_brand || '/{}' ELSE '/' || p_brand || '/' || p_type END AS slashed,
    CASE WHEN p_size % 3 = 0 THEN '/' || p_brand || 'users' WHEN p_size % 3 = 1 THEN '/' || p_brand || '/{}' ELSE '/' || p_brand || '/' || p_type END AS plain FROM part"""
)
def join_path(spark, d):
    k = F.col("p_size") % 3
    a, b = F.concat(F.lit("/"), "p_brand"), F.when(k == 0, F.lit("users")).when(k == 1, F.lit("{}")).otherwise(F.concat(F.lit("/"), "p_type"))
    return table(spark, d, "part").select("p_partkey", paths.join_path(a, b, True).alias("slashed"), paths.join_path(a, b, False).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{}/api/' || p_brand ELSE '{}/' || p_brand END AS url FROM part")
def client_path(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("{}api/"), "p_brand")).otherwise(F.concat(F.lit("{}/"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", paths.client_path(t).alias("url"))


_FILES = "SELECT page_id, regexp_replace(url, '^https?://', '') AS f FROM pages"


def _files(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("f"))


@query(
    f"""SELECT page_id, CASE WHEN starts_with(f, 'example.com/') THEN 'USER' WHEN NOT contains(string_split(f, '/')[1], '.') THEN 'STDLIB' ELSE 'DEP' END AS origin,
    replace(replace(f, '/', '_'), ':', '_') AS safe, f[1:8] AS short, CASE WHEN starts_with(f, 'example.com/') THEN f[13:] ELSE f END AS rel FROM ({_FILES})"""
)
def origin(spark, d):
    f = F.col("f")
    return _files(spark, d).select("page_id", classify.origin(f, F.lit("example.com")).alias("origin"), paths.sanitize(f).alias("safe"), paths.short(f).alias("short"), paths.relative_file(f, F.lit("example.com")).alias("rel"))


_GO = f"""SELECT page_id, f || CASE page_id % 7 WHEN 0 THEN '.pb.go' WHEN 1 THEN '.generated.go' WHEN 2 THEN '/models_gen.go' WHEN 3 THEN '_mock.go' WHEN 4 THEN '/zzz_x.go' WHEN 5 THEN '_test.go' ELSE '.go' END AS g FROM ({_FILES})"""


def _go_files(spark, d) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".pb.go", ".generated.go", "/models_gen.go", "_mock.go", "/zzz_x.go", "_test.go", ".go")])
    return _files(spark, d).select("page_id", F.concat("f", F.get(ends, (F.col("page_id") % 7).cast("int"))).alias("g"))


@query(f"SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'PROTOC' WHEN 1 THEN 'GQLGEN' WHEN 2 THEN 'GQLGEN' WHEN 3 THEN 'MOCKGEN' WHEN 4 THEN 'MOCKGEN' ELSE 'NONE' END AS generator, page_id % 7 IN (3, 4, 5) AS excluded FROM ({_GO})")
def generator(spark, d):
    mock = classify.mock_file_name(F.col("g"))
    return _go_files(spark, d).select("page_id", classify.generator(F.col("g"), mock).alias("generator"), (classify.test_file(F.col("g")) | mock).alias("excluded"))


@query(f"SELECT host, bool_and(m) FILTER (WHERE NOT t) AND count(*) FILTER (WHERE NOT t) > 0 AS mock FROM (SELECT string_split(g, '/')[1] || '/' || page_id % 50 AS host, page_id % 7 IN (3, 4) AS m, page_id % 7 = 5 AS t FROM ({_GO})) GROUP BY host")
def mock_pkg(spark, d):
    g = _go_files(spark, d).select(F.concat(F.substring_index("g", "/", 1), F.lit("/"), (F.col("page_id") % 50).cast("string")).alias("host"), classify.mock_file_name(F.col("g")).alias("m"), classify.test_file(F.col("g")).alias("t"))
    return g.groupBy("host").agg((F.bool_and(F.when(~F.col("t"), F.col("m"))) & (F.count_if(~F.col("t")) > 0)).alias("mock"))


_PKGS = f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x.io/pb/' || f WHEN 1 THEN f || '/api' WHEN 2 THEN 'pb' ELSE f || '/pbx' END AS p FROM ({_FILES})"


@query(f"SELECT page_id, contains(p, '/pb/') OR ends_with(p, '/pb') OR contains(p, '/api/') OR ends_with(p, '/api') AS pb, list_has_any(string_split(p, '/'), ['mock', 'mocks']) AS mock FROM ({_PKGS})")
def pb_match(spark, d):
    k = F.col("page_id") % 4
    p = F.when(k == 0, F.concat(F.lit("x.io/pb/"), "f")).when(k == 1, F.concat("f", F.lit("/api"))).when(k == 2, F.lit("pb")).otherwise(F.concat("f", F.lit("/pbx")))
    return _files(spark, d).select("page_id", classify.pb_match(p).alias("pb"), classify.mock_path(p).alias("mock"))


@query(
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN 'pb.Svc/' || event_type END AS client, CASE event_id % 3 WHEN 0 THEN 'pb.Svc/' || event_type ELSE NULL END AS stream,
    CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'SEND' ELSE 'RECV' END END AS op FROM events"""
)
def stream_port(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    client = classify.grpc_client(F.when(F.col("event_type") == "view", "x.io/other").otherwise("x.io/pb"), F.lit("pb"), F.lit("SvcClient"), F.col("event_type"))
    port = classify.stream_port(F.lit("x.io/pb"), F.lit("pb"), F.concat(F.lit("Svc_"), "event_type", F.when(F.col("event_id") % 3 == 0, "Server").otherwise("Other")), F.when(F.col("event_id") % 2 == 0, "Send").otherwise("CloseAndRecv"))
    return e.select("event_id", client.alias("client"), port["contract"].alias("stream"), port["op"].alias("op"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unary' WHEN 1 THEN 'server' WHEN 2 THEN CASE WHEN p_size % 8 = 2 THEN 'bidi' ELSE 'client' END ELSE 'none' END AS kind FROM part")
def handler_kind(spark, d):
    k = F.col("p_size") % 4
    params = F.when(k == 0, F.array(F.lit("context.Context"), F.lit("*pb.Req"))).when(k == 1, F.array(F.lit("*pb.Req"), F.lit("x.io/pb.Svc_RpcServer"))).when(k == 2, F.array(F.lit("x.io/pb.Svc_RpcServer"))).otherwise(F.array(F.lit("int")))
    return table(spark, d, "part").select("p_partkey", classify.handler_kind(params, F.array(F.lit("error")), F.lit("Rpc"), F.lit("Svc"), F.col("p_size") % 8 == 2).alias("kind"))


# ---- cells ----


@query(f"SELECT event_type, count(*) AS uses, {_digest_sql("''", "''", "'msg:kafka:' || event_type", "'kafka'")} AS sym FROM events GROUP BY event_type")
def topic_cells(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("uses"))
    return e.withColumn("sym", ident.contract_iid(paths.topic_name(F.col("event_type")), "kafka"))


@query(
    """SELECT w.event_type, w.user_id AS w_user, r.user_id AS r_user FROM (SELECT DISTINCT event_type, user_id FROM events WHERE value > 50) w
    JOIN (SELECT DISTINCT event_type, user_id FROM events WHERE value <= 5) r USING (event_type)"""
)
def topic_join(spark, d):
    e = table(spark, d, "events")
    w, r = (e.where(c).select("event_type", F.col("user_id").alias("user")).distinct() for c in ("value > 50", "value <= 5"))
    return links.cell_join(w, r, "event_type")


@query(
    """SELECT w.event_type, w.user_id AS w_user, r.user_id AS r_user FROM (SELECT user_id, event_type, CASE WHEN max(value) > 90 THEN 'T' || user_id % 3 END AS t FROM events GROUP BY user_id, event_type) w
    JOIN (SELECT user_id, event_type, CASE WHEN min(value) > 1 THEN 'T' || user_id % 3 END AS t FROM events GROUP BY user_id, event_type) r USING (event_type) WHERE w.t IS NULL OR r.t IS NULL OR w.t = r.t"""
)
def cell_narrow(spark, d):
    tag = F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string"))
    g = table(spark, d, "events").groupBy("user_id", "event_type")
    w = g.agg(F.max("value").alias("v")).select("event_type", F.col("user_id").alias("user"), F.when(F.col("v") > 90, tag).alias("tag"))
    r = g.agg(F.min("value").alias("v")).select("event_type", F.col("user_id").alias("user"), F.when(F.col("v") > 1, tag).alias("tag"))
    return links.cell_join(w, r, "event_type", "tag").select("event_type", "w_user", "r_user")


@query(
    """SELECT side, count(*) AS uses, count(*) FILTER (WHERE topic IS NOT NULL) AS resolved, count(*) FILTER (WHERE topic IS NULL AND cause = 'param') AS from_param, count(*) FILTER (WHERE topic IS NULL AND cause = 'field') AS from_config,
    count(*) FILTER (WHERE topic IS NULL AND cause = 'call') AS other, count(DISTINCT topic) AS cells FROM (SELECT CASE WHEN value > 50 THEN 'produce' ELSE 'consume' END AS side, CASE WHEN event_id % 4 <> 0 THEN event_type END AS topic,
    CASE event_id % 3 WHEN 0 THEN 'param' WHEN 1 THEN 'field' ELSE 'call' END AS cause FROM events) GROUP BY side"""
)
def topic_census(spark, d):
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select(F.when(F.col("value") > 50, "produce").otherwise("consume").alias("side"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("topic"), F.when(k == 0, "param").when(k == 1, "field").otherwise("call").alias("cause"))
    return census.topic_census(e)


@query("SELECT sum(n)::BIGINT AS routes, string_agg(event_type || '=' || n, ' ' ORDER BY event_type || '=' || n) AS by_framework FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def route_census(spark, d):
    return census.route_census(table(spark, d, "events"), "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def top_unclassified(spark, d):
    return census.most_frequent(table(spark, d, "events"), "user_id")


# ---- satisfaction ----

_METHODS = """SELECT o_custkey AS type_key, p_name AS method_id, p_brand AS sig, bool_or(l_returnflag = 'N') AS in_value_set FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
_IFACES = "SELECT DISTINCT p_brand || '/' || p_size AS iface_key, p_name AS method_id, p_brand AS sig FROM part"
_PAIRS = f"""SELECT type_key, iface_key, count(*) FILTER (WHERE in_value_set) < n AS pointer_only FROM ({_METHODS}) JOIN ({_IFACES}) USING (method_id, sig)
  JOIN (SELECT iface_key, count(*) AS n FROM ({_IFACES}) GROUP BY 1) USING (iface_key) GROUP BY type_key, iface_key, n HAVING count(*) = n"""


def _methods(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    bought = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("o_custkey").alias("type_key"), F.col("p_name").alias("method_id"), F.col("p_brand").alias("sig")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("in_value_set"))


def _interfaces(spark, d) -> DataFrame:
    """A brand's parts of a size are the methods of an interface."""
    return table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("iface_key"), F.col("p_name").alias("method_id"), F.col("p_brand").alias("sig")).distinct()


@query(_PAIRS)
def satisfies(spark, d):
    return satisfaction.satisfies(_methods(spark, d), _interfaces(spark, d))


@query(
    f"""SELECT s_suppkey, i.iface_key, i.method_id, p.type_key, 'f' || p.type_key || '.' || m.method_id AS callee FROM (SELECT s_suppkey, 'Brand#' || (11 + s_suppkey % 5) || '/' || (1 + s_suppkey % 50) AS iface_key FROM supplier)
    JOIN ({_IFACES}) i USING (iface_key) JOIN ({_PAIRS}) p USING (iface_key) JOIN ({_METHODS}) m ON m.type_key = p.type_key AND m.method_id = i.method_id"""
)
def class_hierarchy(spark, d):
    """Suppliers invoke every method of an interface."""
    methods = _methods(spark, d)
    pairs = satisfaction.satisfies(methods, _interfaces(spark, d))
    own = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 11).cast("string"), F.lit("/"), (F.col("s_suppkey") % 50 + 1).cast("string"))
    calls = table(spark, d, "supplier").select("s_suppkey", own.alias("iface_key")).join(_interfaces(spark, d).select("iface_key", "method_id"), "iface_key")
    decl = methods.select("type_key", "method_id", F.concat(F.lit("f"), F.col("type_key").cast("string"), F.lit("."), "method_id").alias("decl_fn"))
    return satisfaction.class_hierarchy(calls, pairs, decl).select("s_suppkey", "iface_key", "method_id", "type_key", F.col("decl_fn").alias("callee"))


@query(
    f"""SELECT iface_key, method_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS targets FROM (SELECT i.iface_key, i.method_id, 'f' || p.type_key || '.' || m.method_id AS t FROM ({_IFACES}) i JOIN ({_PAIRS}) p USING (iface_key)
    JOIN ({_METHODS}) m ON m.type_key = p.type_key AND m.method_id = i.method_id) GROUP BY 1, 2 HAVING count(DISTINCT t) <= 10"""
)
def declared_impls(spark, d):
    methods = _methods(spark, d)
    pairs = satisfaction.satisfies(methods, _interfaces(spark, d))
    sites = _interfaces(spark, d).select("iface_key", "method_id")
    decl = methods.select("type_key", "method_id", F.concat(F.lit("f"), F.col("type_key").cast("string"), F.lit("."), "method_id").alias("decl_fn"))
    return satisfaction.declared_implementations(sites, pairs, decl).withColumn("targets", _text("targets"))


@query("SELECT o_orderkey, CASE WHEN a = b THEN a END AS value, CASE WHEN a IS NULL THEN 'unclassified' WHEN a = b THEN 'unique' ELSE 'ambiguous' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def unique_or_refuse(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return satisfaction.unique_or_refuse(line, ["o_orderkey"], "l_suppkey", table(spark, d, "orders"))


def _big_sql(x: str) -> str:
    return f"unhex(printf('%016x', octet_length(encode({x})))) || encode({x})"


@query(f"""SELECT type_key, sha256(unhex(string_agg(hex({_big_sql('method_id')}) || hex({_big_sql('sig')}) || hex({_big_sql("CASE WHEN in_value_set THEN 'pv' ELSE 'p' END")}), '' ORDER BY method_id, sig, in_value_set))) AS msfp FROM ({_METHODS}) GROUP BY type_key""")
def method_fingerprints(spark, d):
    return satisfaction.method_fingerprints(_methods(spark, d))


@query(f"SELECT iface_key, sha256(unhex(string_agg(hex({_big_sql('method_id')}) || hex({_big_sql('sig')}), '' ORDER BY method_id, sig))) AS ifp FROM ({_IFACES}) GROUP BY iface_key")
def interface_fingerprints(spark, d):
    return satisfaction.interface_fingerprints(_interfaces(spark, d))


# ---- prefixes, rules, snapshots, changes ----

_PREFIXES = ["https://", "https://www", "https://blog", "https://m", "http://", "https://www.e", "https://blog.example.com/a"]


@query("SELECT page_id, " + "CASE " + " ".join(f"WHEN starts_with(url, '{p}') THEN '{p}'" for p in sorted(_PREFIXES, key=lambda p: (-len(p), p))) + " END AS prefix FROM pages")
def longest_prefix(spark, d):
    prefixes = spark.createDataFrame([(p,) for p in _PREFIXES], "p string")
    return links.longest_prefix_join(table(spark, d, "pages").select("page_id", "url"), "url", ["page_id"], prefixes, "p").select("page_id", "prefix")


@query("SELECT s_suppkey::VARCHAR AS key FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A')")
def missing_scope(spark, d):
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    built = table(spark, d, "lineitem").where("l_quantity > 49 AND l_returnflag = 'A'").select(F.col("l_suppkey").cast("string").alias("key"))
    return links.missing(asked, built, key="key")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 8")
def snapshot_gc(spark, d):
    return links.keep_newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 8, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    """WITH e AS (SELECT l_orderkey AS caller, l_linenumber AS ordinal, l_suppkey AS callee, count(*) OVER (PARTITION BY l_orderkey) AS n_calls FROM lineitem),
    fn AS (SELECT o_orderkey AS fn FROM orders WHERE o_orderstatus <> 'P'), calls AS (SELECT l_orderkey AS fn, l_linenumber AS ordinal FROM lineitem WHERE l_linenumber < 7), ext AS (SELECT s_suppkey AS fn FROM supplier WHERE s_acctbal > 0),
    known AS (SELECT * FROM e WHERE caller IN (SELECT fn FROM fn))
    SELECT 'unknown_caller' AS check, (SELECT count(DISTINCT caller) FROM e WHERE caller NOT IN (SELECT fn FROM fn)) AS n
    UNION ALL SELECT 'count_drift', (SELECT count(*) FROM (SELECT DISTINCT caller, n_calls FROM known) k LEFT JOIN (SELECT fn, count(*) AS c FROM calls GROUP BY fn) ON caller = fn WHERE coalesce(c, 0) <> n_calls)
    UNION ALL SELECT 'ordinal_out_of_range', (SELECT count(*) FROM (SELECT DISTINCT caller, ordinal FROM known) k WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.fn = k.caller AND c.ordinal = k.ordinal))
    UNION ALL SELECT 'unknown_callee', (SELECT count(DISTINCT callee) FROM e WHERE callee NOT IN (SELECT fn FROM fn UNION SELECT fn FROM ext))"""
)
def snapshot_validate(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("callee"))
    counts = line.groupBy("caller").agg(F.count("*").alias("n_calls"))
    fn = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fn"))
    calls = line.where("ordinal < 7").select(F.col("caller").alias("fn"), "ordinal")
    return links.rebind_errors(line.join(counts, "caller"), fn, calls, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("fn")))


@query("""SELECT o_orderkey, '{"fqn":"f' || o_orderkey || '","file":"' || o_orderpriority || '"}' AS entry FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders))""")
def changed_fns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"), "o_totalprice")
    files = o.agg(F.max_by("file", F.struct("o_totalprice", "o_orderkey")).alias("file"))
    return links.changed(o, files).select("o_orderkey", F.to_json(F.struct(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("fqn"), "file")).alias("entry"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS params FROM lineitem GROUP BY l_orderkey")
def merge_params(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("handler_iid"), F.col("l_suppkey").cast("string").alias("contract_iid"), F.array("l_linenumber").alias("params"))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("iid")).distinct()
    return links.bind_handlers(f, c).select(F.col("iid").alias("l_orderkey"), _text("source_params").alias("params"))


@query("SELECT l_orderkey, bit_or(CASE WHEN l_returnflag = 'R' AND l_linenumber < 63 THEN (1::BIGINT << l_linenumber) ELSE 0::BIGINT END)::BIGINT AS error_results FROM lineitem GROUP BY l_orderkey")
def error_mask(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("e"))
    return links.error_mask(line, "l_orderkey", "l_linenumber", "e")


@query("SELECT kind, package, iid, count(*) AS n FROM (SELECT DISTINCT 'HTTP' AS kind, o_custkey AS package, o_orderpriority AS iid FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'GRPC', o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'O') GROUP BY ALL")
def endpoints(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "HTTP").otherwise("GRPC").alias("kind"), F.col("o_custkey").alias("package"), F.col("o_orderpriority").alias("iid"))
    return links.distinct_endpoints(o).groupBy("kind", "package", "iid").agg(F.count("*").alias("n"))


@query(
    """SELECT 'ENDPOINT' AS kind, r_name AS name, '' AS handler FROM region UNION ALL SELECT 'GRPC', n_name, coalesce(r_name, '') FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'GRAPHQL', s_name, coalesce(n_name, '') FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'HTTP', c_name, coalesce(n_name, '') FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def contracts_dump(spark, d):
    r, n, s, c = (table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    by = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("h"))
    row = lambda x, kind, name, h: x.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), h.alias("handler"))
    grpc = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return row(r, "ENDPOINT", "r_name", F.lit("")).unionByName(row(grpc, "GRPC", "n_name", F.coalesce("r_name", F.lit("")))).unionByName(row(s.join(by, F.col("s_nationkey") == F.col("k"), "left"), "GRAPHQL", "s_name", F.coalesce("h", F.lit("")))).unionByName(row(c.join(by, F.col("c_nationkey") == F.col("k"), "left"), "HTTP", "c_name", F.coalesce("h", F.lit(""))))


# ---- recursion ----

_STEPS = "SELECT DISTINCT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events QUALIFY dst IS NOT NULL"
_ALL = "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL"


def _steps(spark, d) -> DataFrame:
    from pyspark.sql.window import Window

    nxt = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("src"), nxt.alias("dst"), "event_id", "event_type").where("dst IS NOT NULL")


def _all_users(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id").where("user_id IS NOT NULL").distinct().select(F.col("user_id").alias("source"), F.col("user_id").alias("node"))


@query(f"WITH RECURSIVE e AS ({_STEPS}), r AS (SELECT user_id AS source, user_id AS node FROM ({_ALL}) UNION SELECT r.source, e.dst FROM r JOIN e ON r.node = e.src) SELECT source, node FROM r")
def reach(spark, d):
    """From every user."""
    return fixpoint.reachable(_steps(spark, d), _all_users(spark, d))


_PARENTS = "SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders"


@query(f"WITH RECURSIVE p AS ({_PARENTS}), r AS (SELECT node, parent AS ancestor, 1 AS depth FROM p WHERE parent IS NOT NULL UNION ALL SELECT r.node, p.parent, r.depth + 1 FROM r JOIN p ON r.ancestor = p.node WHERE p.parent IS NOT NULL) SELECT node, ancestor, depth FROM r")
def ancestors(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return fixpoint.ancestors(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("parent")))


_LABELLED = f"""SELECT DISTINCT src, dst, CASE event_type WHEN 'click' THEN 'proj' WHEN 'view' THEN 'inject' ELSE 'plain' END AS op, (src % 3)::INT AS field
  FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, event_type FROM events) WHERE dst IS NOT NULL"""


@query(
    f"""WITH RECURSIVE e AS ({_LABELLED}), r AS (SELECT user_id AS source, user_id AS node, []::INT[] AS path FROM ({_ALL})
    UNION SELECT r.source, e.dst, CASE e.op WHEN 'inject' THEN list_prepend(e.field, r.path)[1:2] WHEN 'proj' THEN r.path[2:] ELSE r.path END FROM r JOIN e ON r.node = e.src
      WHERE e.op <> 'proj' OR (len(r.path) > 0 AND r.path[1] = e.field)) SELECT source, node, array_to_string(path, '.') AS path FROM r"""
)
def reach_k2(spark, d):
    """From every user; the states alone, as no column tells the alias bit."""
    op = F.when(F.col("event_type") == "click", "proj").when(F.col("event_type") == "view", "inject").otherwise("plain")
    e = _steps(spark, d).select("src", "dst", op.alias("op"), (F.col("src") % 3).cast("int").alias("field"))
    return fixpoint.reach_states(e, _all_users(spark, d).withColumn("depth", F.lit(0)), path=lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), "."))


@query(
    """WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages), k AS (SELECT s, unnest(range(0, len(s))) AS k FROM p)
    SELECT DISTINCT array_to_string(s[1:k+1], '/') AS node, CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(s[2:k+1], '/') END AS prefix, k::INT AS apps FROM k WHERE k <= 8 AND len(list_filter(s[2:k+1], lambda x: x = '')) = 0"""
)
def prefix_fixpoint(spark, d):
    """Prefixes along the trie of URL segments: a host seeds the empty prefix, each path its segments."""
    seg = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    p = table(spark, d, "pages").select(seg.alias("s"))
    e = p.select(F.posexplode(F.slice("s", F.lit(2), F.size("s"))).alias("i", "part"), "s").where("part <> ''").select(F.array_join(F.slice("s", F.lit(1), F.col("i") + 1), "/").alias("src"), F.array_join(F.slice("s", F.lit(1), F.col("i") + 2), "/").alias("dst"), F.concat(F.lit("/"), "part").alias("append"), F.lit(False).alias("slash")).distinct()
    seeds = p.select(F.element_at("s", 1).alias("node")).distinct().select("node", F.lit(0).alias("obj"), F.lit("").alias("prefix"))
    return fixpoint.prefixes(e, seeds)[0].drop("obj")


@query(
    """WITH m AS (SELECT 'r' || r_regionkey AS obj, '/' || r_name AS route FROM region UNION ALL SELECT 'n' || n_nationkey, '/' || r_name || '/n/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION SELECT c_mktsegment, '/' || r_name || '/n/' || n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT obj, route, '' AS stripped FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY route) AS r FROM m) WHERE r <= 8"""
)
def mounts(spark, d):
    """Nations mounted under regions, customers' segments under nations."""
    n = table(spark, d, "nation")
    top = table(spark, d, "region").select(F.lit("root").alias("parent"), F.lit("").alias("rel"), F.concat(F.lit("/"), "r_name").alias("prefix"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"))
    mid = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit("/n").alias("rel"), F.concat(F.lit("/"), "n_name").alias("prefix"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    low = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.lit("").alias("rel"), F.concat(F.lit("/"), "c_mktsegment").alias("prefix"), F.col("c_mktsegment").alias("child")).distinct()
    return fixpoint.mounts(top.unionByName(mid).unionByName(low).withColumn("strip", F.lit(False)).withColumn("known", F.lit(True)))


@query("SELECT p_partkey, '/api/' || p_brand || '/{}' AS template FROM part")
def string_eval(spark, d):
    """For each part: const + const joined, then a format."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    v = lambda x: F.concat(F.col("p_partkey").cast("string"), F.lit(x))
    none = F.array().cast("array<string>")
    node = lambda x, op, text, args=none: F.struct(v(x).alias("value"), F.lit(op).alias("op"), text.alias("text"), args.alias("args"))
    nodes = p.select("p_partkey", F.inline(F.array(node("a", "const", F.lit("/api/")), node("b", "const", F.col("p_brand")), node("c", "concat", F.lit(None).cast("string"), F.array(v("a"), v("b"))), node("p", "param", F.lit(None).cast("string")), node("r", "join", F.lit(None).cast("string"), F.array(v("c"), v("p"))))))
    done = fixpoint.evaluate_strings(nodes.select("value", "op", "text", "args"))
    return done.where(F.col("value").endswith("r")).select(F.regexp_replace("value", "r$", "").cast("long").alias("p_partkey"), S.template(F.col("str")).alias("template"))


# ---- what a program declares and calls ----


@query(
    """SELECT c_custkey::VARCHAR AS fn FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_custkey = s_suppkey
    WHERE n_nationkey % 3 > 0 AND n_regionkey <> 2 AND c_mktsegment <> 'BUILDING'"""
)
def declared_methods(spark, d):
    """Customers are functions, those with money collected; suppliers' keys are methods of the nation that is their type."""
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    key = lambda x: F.col(x).cast("string").alias("fn")
    types = n.select(F.col("n_nationkey").alias("type_key"), F.when(F.col("n_nationkey") % 3 == 0, "other").alias("alias_of"), F.when(F.col("n_regionkey") == 2, 1).otherwise(0).alias("n_type_params"))
    methods = s.select(F.col("s_nationkey").alias("type_key"), F.col("s_suppkey").cast("string").alias("decl_fn"))
    return externals.with_declared_methods(c.where("c_acctbal > 0").select(key("c_custkey")), types, methods, c.where("c_mktsegment <> 'BUILDING'").select(key("c_custkey")))


@query("SELECT o_orderkey AS fn FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_orderpriority <> '1-URGENT' AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderstatus <> 'P'")
def external_functions(spark, d):
    o = table(spark, d, "orders")
    fns = o.select(F.col("o_orderkey").alias("fn"), F.col("o_custkey").alias("pkg_path"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("f")).alias("parent_fn"), F.when(F.col("o_orderpriority") == "1-URGENT", "wrapper").alias("synthetic"), F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("T"))).alias("type_args"), F.col("o_orderstatus").alias("file"))
    dependencies = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("pkg_path"))
    return externals.external_functions(fns, dependencies, o.where("o_orderstatus = 'P'").select(F.col("o_orderstatus").alias("file"))).select("fn")


@query(
    """SELECT DISTINCT l_orderkey * 10 + l_linenumber AS fn, p_partkey AS declared FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag <> 'N' AND l_linenumber % 4 = p_size % 4 AND (l_linestatus = 'F') = (p_size > 25)"""
)
def wrapped_methods(spark, d):
    """Lines are wrappers of their part's method if both take the same parameters."""
    line, p = table(spark, d, "lineitem"), table(spark, d, "part")
    take = lambda n: F.array_repeat(F.lit("int"), (n % 4).cast("int"))
    targets = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fn"), F.col("l_partkey").alias("object"), take(F.col("l_linenumber")).alias("params"), (F.col("l_linestatus") == "F").alias("variadic"), F.lit("wrapper").alias("synthetic"), F.when(F.col("l_returnflag") == "N", F.array(F.lit("T"))).alias("type_args"))
    return externals.declared_targets(targets, p.select(F.col("p_partkey").alias("fn"), F.col("p_partkey").alias("object"), take(F.col("p_size")).alias("params"), (F.col("p_size") > 25).alias("variadic")))


@query(
    f"""SELECT l_orderkey, array_to_string(t, ',') || CASE WHEN e > 0 THEN ',0' ELSE '' END AS targets, CASE WHEN e > 0 THEN 1.0::DOUBLE / (n + 1) WHEN n > 1 THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END AS confidence
    FROM ({_SITES}) JOIN (SELECT l_orderkey, count(*) FILTER (WHERE s_acctbal < 0) AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) USING (l_orderkey) WHERE n <= 10"""
)
def default_leaf(spark, d):
    """Suppliers in debt are external targets."""
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")
    outside = line.groupBy("l_orderkey").agg(F.count_if(F.col("s_acctbal") < 0).alias("n_external"))
    sites = _sites(spark, d).where("NOT capped").join(outside, "l_orderkey").withColumn("placeholder", F.lit(0).cast("long"))
    return externals.with_default_leaf(sites).select("l_orderkey", _text("targets").alias("targets"), "confidence")


@query(
    """WITH RECURSIVE up AS (SELECT p_partkey AS fn, (p_partkey // 3) AS parent FROM part), r AS (SELECT fn FROM (SELECT p_partkey AS fn FROM part WHERE p_size = 7 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    UNION SELECT up.fn FROM r JOIN up ON up.parent = r.fn) SELECT fn FROM r UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"""
)
def function_universe(spark, d):
    """Parts are nested in the part of a third of their number."""
    p = table(spark, d, "part")
    fns = p.select(F.col("p_partkey").alias("fn"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent_fn"))
    before = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("fn"))
    return externals.function_universe(before, p.where("p_size = 7").select(F.col("p_partkey").alias("fn")), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("decl_fn")), fns)


_MODE = "['AIR', 'RAIL', 'SHIP', 'MAIL'][l_suppkey % 4 + 1]"


def _mode() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("AIR", "RAIL", "SHIP", "MAIL")]), (F.col("l_suppkey") % 4 + 1).cast("int"))


_PARAMS = f"SELECT l_orderkey AS fn, l_linenumber AS idx, CASE {_MODE} WHEN 'AIR' THEN '*net/http.Request' WHEN 'RAIL' THEN '*a.b/pb.Message' WHEN 'SHIP' THEN '[]byte' ELSE 'int' END AS type FROM lineitem"


def _params(spark, d) -> DataFrame:
    mode = _mode()
    kind = F.when(mode == "AIR", "*net/http.Request").when(mode == "RAIL", "*a.b/pb.Message").when(mode == "SHIP", "[]byte").otherwise("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("int").alias("idx"), kind.alias("type"))


@query(f"SELECT fn, array_to_string(list_sort(list(DISTINCT idx)), ',') AS params FROM ({_PARAMS}) WHERE type = '*net/http.Request' GROUP BY fn")
def http_request_params(spark, d):
    from . import rules

    return signatures.http_request_params(_params(spark, d), rules.request_types(spark)).withColumn("params", _text("params"))


@query(f"SELECT fn, array_to_string(list_sort(list(DISTINCT idx)), ',') AS params FROM ({_PARAMS}) WHERE type = '*a.b/pb.Message' GROUP BY fn")
def request_message_params(spark, d):
    types = spark.createDataFrame([("a.b/pb", "Message", "struct"), ("a.b/pb", "Other", "interface"), ("a.b/x", "Message", "struct")], "pkg_path string, name string, kind string")
    return signatures.request_message_params(_params(spark, d), types).withColumn("params", _text("params"))


@query(
    f"""SELECT o_orderkey AS fn, CASE WHEN o_orderstatus = 'O' THEN 'recv *T false;' ELSE '' END || coalesce(p, '') AS params, o_orderstatus = 'O' AS has_receiver
    FROM orders LEFT JOIN (SELECT fn, string_agg('p' || idx || ' ' || type || ' ' || (starts_with(type, '*') OR starts_with(type, '[]') OR starts_with(type, 'map[')), ';' ORDER BY idx, type) AS p FROM ({_PARAMS}) GROUP BY fn) ON fn = o_orderkey"""
)
def function_signatures(spark, d):
    fns = table(spark, d, "orders").select(F.col("o_orderkey").alias("fn"), F.when(F.col("o_orderstatus") == "O", "*T").alias("recv_type"), F.lit(False).alias("variadic"))
    named = _params(spark, d).withColumn("name", F.concat(F.lit("p"), F.col("idx").cast("string")))
    shown = signatures.signatures(fns, named, named.limit(0).select("fn", "idx", "type"))
    text = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["name"], p["type"], p["by_ref"].cast("string"))), ";")
    # a receiver without parameters has no separator behind it in an array_join
    return shown.select("fn", F.when(F.col("has_receiver") & (F.size("params") == 1), F.concat(text, F.lit(";"))).otherwise(text).alias("params"), "has_receiver")


@query(
    f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_MODE} AS l_shipmode, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey % 3, l_linenumber, l_suppkey, l_orderkey) AS r, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
    SELECT o_custkey AS dispatcher, l_shipmode AS method, CASE WHEN l_linenumber % 2 = 0 THEN 'a,b' ELSE '' END AS args FROM i WHERE r = 1"""
)
def resolver_calls(spark, d):
    """Customers dispatch over their orders; lines that came back are invokes, even ones with two named arguments."""
    o = table(spark, d, "orders")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("int").alias("block"), F.col("l_suppkey").alias("ord"), _mode().alias("method"), "l_returnflag")
    args = line.where("block % 2 = 0").select("fn", "block", "ord").distinct().select("fn", "block", "ord", F.inline(F.array(F.struct(F.lit(1).alias("idx"), F.lit("a").alias("key")), F.struct(F.lit(2).alias("idx"), F.lit("b").alias("key")))))
    found = routes.resolver_calls(o.select(F.col("o_custkey").alias("dispatcher"), F.col("o_orderkey").alias("fn"), (F.col("o_orderkey") % 3).alias("level")), line.where("l_returnflag = 'R'"), args)
    return found.withColumn("args", signatures.arg_names(F.col("args")))


@query("SELECT l_orderkey AS fn, l_suppkey AS src, l_partkey AS dst, l_returnflag = 'R' AS via_alias, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_returnflag = 'R') - 1 AS position FROM lineitem")
def ordered_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("via_alias"))
    return flow.ordered_edges(e).withColumn("position", F.col("position").cast("long"))


@query(
    f"""SELECT o_orderkey AS reg, CASE WHEN o_orderkey % 4 = 0 THEN 'GET' WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderstatus = 'P' THEN '*' ELSE upper(o_orderpriority) END
      WHEN o_orderkey % 4 = 2 THEN coalesce(t, '*') ELSE coalesce(chained, '*') END AS methods
    FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT m)), ',') AS t, array_to_string(list_sort(list(DISTINCT m) FILTER (WHERE r <= 8)), ',') AS chained
      FROM (SELECT l_orderkey, {_MODE} AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS r FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def route_methods(spark, d):
    """Orders register routes: by a fixed method, a constant, a list of constants, or by the lines chained with them."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    kind, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    texts = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(_mode())).alias("texts"))
    regs = o.join(texts, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("reg"), F.when(kind == 0, "GET").otherwise("").alias("method"), (kind == 3).alias("route_chain"), F.lit(2).alias("n_args"), F.when(kind == 1, 0).otherwise(-1).alias("method_arg"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("method_text"), F.when(kind == 2, 1).otherwise(-1).alias("methods_arg"), F.col("texts").alias("methods_texts"), F.concat(F.lit("v"), key).alias("value"), F.lit(None).cast("string").alias("recv"),
    )
    # an order's lines are called one on the other
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    called = line.select("l_orderkey", _mode().alias("mode"), place.alias("r"))
    at = lambda r: F.when(r == 0, F.concat(F.lit("v"), F.col("l_orderkey").cast("string"))).otherwise(F.concat_ws("/", F.lit("c"), F.col("l_orderkey").cast("string"), r.cast("string")))
    calls = called.select(at(F.col("r")).alias("value"), at(F.col("r") - 1).alias("recv"), F.lit(True).alias("links"), F.array("mode").alias("texts"))
    return routes.route_methods(regs, routes.chained_methods(regs.where("route_chain").select("reg", "value", "recv"), calls)).select("reg", _text("methods").alias("methods"))


@query(
    """SELECT l_orderkey AS fn, l_partkey AS ord, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 + o_custkey % 5)::INT AS id, (l_partkey % 4 + 1)::INT AS argc
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A') JOIN orders ON l_orderkey = o_orderkey"""
)
def closure_sites(spark, d):
    """Returned lines make closures of their parts, each with one captured value."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("ord"), F.col("l_partkey").alias("callee"), F.col("l_partkey").cast("string").alias("value")).distinct()
    bindings = line.select("fn", "block", "ord", F.lit(0).alias("idx"), "value", F.lit("int").alias("type"))
    n_params = table(spark, d, "part").select(F.col("p_partkey").alias("fn"), (F.col("p_partkey") % 4).cast("int").alias("n"))
    n_calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("fn"), (F.col("o_custkey") % 5).cast("int").alias("n"))
    return flow.closure_sites(line.drop("value"), bindings, n_params, n_calls)[0].select("fn", "ord", "id", F.col("argc").cast("int").alias("argc"))


@query(
    """SELECT DISTINCT user_id AS fn, CASE WHEN event_type = 'click' THEN 'OUT_FIELD' ELSE 'IN_GLOBAL' END AS kind, 'msg:kafka:' || event_type AS sym_name, CASE WHEN user_id % 2 = 0 THEN 'm' || event_id || '.Value' ELSE 'm' || event_id END AS value FROM events"""
)
def topic_cell_vertices(spark, d):
    from . import rules

    e = table(spark, d, "events")
    known = F.col("user_id") % 2 == 0
    m = e.select(F.col("user_id").alias("fn"), F.when(F.col("event_type") == "click", "produce").otherwise("consume").alias("role"), F.array("event_type", "event_type").alias("topics"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), F.when(known, "github.com/segmentio/kafka-go").alias("type_pkg"), F.when(known, "Message").alias("type_name"))
    return flow.topic_cells(m, rules.payload_fields(spark)).drop("sym")


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '*' || p_brand WHEN 1 THEN 'map[string][]' || p_brand WHEN 2 THEN 'func(' || p_brand || ', ...int) error' WHEN 3 THEN p_brand || '[any]'
      WHEN 4 THEN 'struct{a ' || p_brand || '; b any}' ELSE 'interface{A(int); B(' || p_brand || ') error}' END AS text FROM part"""
)
def canonical_types(spark, d):
    """Each part is a type made of its brand, which it names by an alias."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 6).alias("k"))
    none = F.array().cast("array<string>")
    node = lambda key, kind, name, size, children, labels=none: F.struct(key.alias("type_key"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.lit(size).cast("int").alias("size"), children.alias("children"), labels.alias("labels"))
    key = F.concat(F.lit("t"), F.col("p_partkey").cast("string"))
    own, sub = F.concat(key, F.lit("a")), F.concat(key, F.lit("b"))
    null, err, num, text, empty = F.lit(None), F.lit("error"), F.lit("int"), F.lit("string"), F.lit("empty")
    alias = node(own, "alias", F.lit("Local"), None, F.array(F.col("p_brand")))
    made = (
        F.when(F.col("k") == 0, F.array(alias, node(key, "pointer", null, None, F.array(own))))
        .when(F.col("k") == 1, F.array(alias, node(sub, "slice", null, None, F.array(own)), node(key, "map", null, None, F.array(text, sub))))
        .when(F.col("k") == 2, F.array(alias, node(sub, "slice", null, None, F.array(num)), node(key, "func", F.lit("variadic"), 2, F.array(own, sub, err))))
        .when(F.col("k") == 3, F.array(alias, node(key, "named", F.col("p_brand"), None, F.array(empty))))
        .when(F.col("k") == 4, F.array(alias, node(key, "struct", null, None, F.array(own, empty), F.array(F.lit("a"), F.lit("b")))))
        .otherwise(F.array(alias, node(sub, "func", null, 1, F.array(own, err)), node(F.concat(key, F.lit("c")), "func", null, 1, F.array(num)), node(key, "interface", null, None, F.array(sub, F.concat(key, F.lit("c"))), F.array(F.lit("B"), F.lit("A")))))
    )
    fixed = spark.createDataFrame([("int", "basic", "int"), ("string", "basic", "string"), ("error", "named", "error"), ("empty", "interface", None)], "type_key string, kind string, name string")
    fixed = fixed.unionByName(p.select(F.col("p_brand").alias("type_key"), F.lit("named").alias("kind"), F.col("p_brand").alias("name")).distinct()).select("type_key", "kind", "name", F.lit(None).cast("int").alias("size"), none.alias("children"), none.alias("labels"))
    done = signatures.canonical_types(p.select(F.inline(made)).unionByName(fixed))
    return done.where(F.col("type_key").rlike("^t[0-9]+$")).select(F.substring("type_key", 2, 20).cast("long").alias("p_partkey"), "text")
