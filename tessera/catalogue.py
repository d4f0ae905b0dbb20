"""The queries over the driver's tables, and SQL written for each from the definition of what it computes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import rules as R
from .functions.formats import js_number_text
from .operators import contract as C
from .operators import lint as L
from .operators.generate import example_row, generate
from .operators.jsonpath import child, jsonpath
from .operators.openapi import ruleset as openapi_ruleset
from .operators.refs import is_private_host, ref_edges, resolve
from .operators.validate import compile_schema, explode_errors, is_valid, summary, validate, validate_json
from .plans.parsing import parse, unknown_keys
from .plans.types import struct_type
from .sources.documents import glob_match, node_table, plain_scalar_kind

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- schemas

LINEITEM = {
    "type": "object",
    "required": ["l_orderkey", "l_shipdate", "l_quantity"],
    "properties": {
        "l_orderkey": {"type": "integer", "minimum": 0},
        "l_quantity": {"type": "number", "minimum": 1, "maximum": 30},
        "l_discount": {"type": "number", "multipleOf": 0.01, "maximum": 0.05},
        "l_returnflag": {"enum": ["A", "N"]},
        "l_linestatus": {"const": "O"},
        "l_shipdate": {"type": "string", "format": "date-time"},
    },
}
ORDERS = {
    "type": "object",
    "properties": {"o_totalprice": {"type": "number", "exclusiveMinimum": 0, "maximum": 300000}, "o_orderpriority": {"type": "string", "pattern": "^[1-3]-"}},
    "if": {"properties": {"o_orderstatus": {"const": "F"}}, "required": ["o_orderstatus"]},
    "then": {"properties": {"o_totalprice": {"minimum": 100000}}},
    "else": {"properties": {"o_totalprice": {"maximum": 250000}}},
}
PROPS = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 60}}, "required": ["k"], "additionalProperties": False}
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _counts(df: DataFrame, cs, column: str | None = None) -> DataFrame:
    return df.select(is_valid(df, cs, column).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- validation

_LINE_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '{m}' AS message, '{p}' AS path FROM lineitem WHERE {w}"
    for m, p, w in (
        ("must be >= 0", "/l_orderkey", "l_orderkey < 0"),
        ("must be >= 1", "/l_quantity", "l_quantity < 1"),
        ("must be <= 30", "/l_quantity", "l_quantity > 30"),
        ("must be <= 0.05", "/l_discount", "l_discount > 0.05"),
        ("must be a multiple of 0.01", "/l_discount", "abs(l_discount / 0.01 - round(l_discount / 0.01)) > 2 * 2.220446049250313e-16 * greatest(1, abs(l_discount / 0.01))"),
        ('must be one of: "A", "N"', "/l_returnflag", "l_returnflag NOT IN ('A', 'N')"),
        ('must be equal to "O"', "/l_linestatus", "l_linestatus <> 'O'"),
    )
)


@query(_LINE_SQL)
def validate_lineitem_errors(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return explode_errors(validate(df, compile_schema(LINEITEM)), *LINE_KEY).drop("ord")


_LINE_OK = "l_orderkey >= 0 AND l_quantity BETWEEN 1 AND 30 AND l_discount <= 0.05 AND abs(l_discount / 0.01 - round(l_discount / 0.01)) <= 4.440892098500626e-16 * greatest(1, abs(l_discount / 0.01)) AND l_returnflag IN ('A', 'N') AND l_linestatus = 'O'"


@query(f"SELECT ({_LINE_OK}) AS ok, count(*) AS n FROM lineitem GROUP BY 1")
def guard_lineitem_counts(spark, sf_dir):
    return _counts(table(spark, sf_dir, "lineitem"), compile_schema(LINEITEM))


@query("SELECT l_quantity = floor(l_quantity) AS quantity_ok, l_extendedprice = floor(l_extendedprice) AS price_ok, count(*) AS n FROM lineitem GROUP BY 1, 2")
def type_integer_by_value(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    cs = compile_schema({"type": "integer"})
    return df.select(is_valid(df, cs, "l_quantity").alias("quantity_ok"), is_valid(df, cs, "l_extendedprice").alias("price_ok")).groupBy("quantity_ok", "price_ok").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag IN ('A', 'R') AS ok, count(*) AS n FROM lineitem GROUP BY 1")
def enum_returnflag(spark, sf_dir):
    return _counts(table(spark, sf_dir, "lineitem"), compile_schema({"enum": ["A", "R", 7, None]}), "l_returnflag")


@query("SELECT l_linestatus = 'O' AS ok, count(*) AS n FROM lineitem GROUP BY 1")
def const_linestatus(spark, sf_dir):
    return _counts(table(spark, sf_dir, "lineitem"), compile_schema({"const": "O"}), "l_linestatus")


@query("SELECT l_discount >= 0.02 AND l_discount <= 0.08 AS ok, count(*) AS n FROM lineitem GROUP BY 1")
def bounds_discount(spark, sf_dir):
    return _counts(table(spark, sf_dir, "lineitem"), compile_schema({"minimum": 0.02, "maximum": 0.08}), "l_discount")


@query("SELECT l_tax > 0.02 AND l_tax < 0.06 AS ok, count(*) AS n FROM lineitem GROUP BY 1")
def exclusive_bounds_tax(spark, sf_dir):
    return _counts(table(spark, sf_dir, "lineitem"), compile_schema({"exclusiveMinimum": 0.02, "exclusiveMaximum": 0.06}), "l_tax")


@query("SELECT abs(l_discount / 0.02 - round(l_discount / 0.02)) <= 4.440892098500626e-16 * greatest(1, abs(l_discount / 0.02)) AS fraction_ok, l_quantity % 5 = 0 AS whole_ok, count(*) AS n FROM lineitem GROUP BY 1, 2")
def multiple_of_discount(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(is_valid(df, compile_schema({"multipleOf": 0.02}), "l_discount").alias("fraction_ok"), is_valid(df, compile_schema({"multipleOf": 5}), "l_quantity").alias("whole_ok")).groupBy("fraction_ok", "whole_ok").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) >= 200 AND length(text) <= 3000 AS ok FROM documents")
def min_max_length_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", is_valid(df, compile_schema({"minLength": 200, "maxLength": 3000}), "text").alias("ok"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3][0-9]?$') AS ok FROM part")
def pattern_part_brand(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", is_valid(df, compile_schema({"type": "string", "pattern": "^Brand#[1-3][0-9]?$"}), "p_brand").alias("ok"))


@query("SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]*[02468]$') AS ok FROM customer")
def pattern_customer_name(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", is_valid(df, compile_schema({"pattern": "^Customer#\\d*[02468]$"}), "c_name").alias("ok"))


@query("SELECT o_orderkey, regexp_matches(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$') AS ok FROM orders")
def format_date_time_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    text = lambda p: F.date_format("o_orderdate", p)
    made = F.when(F.col("o_orderkey") % 3 == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, text("yyyy-MM-dd HH:mm:ss")).otherwise(text("yyyy-MM-dd'T'HH:mm:ss"))
    df = df.withColumn("t", made)
    return df.select("o_orderkey", is_valid(df, compile_schema({"format": "date-time"}, ["date-time"]), "t").alias("ok"))


@query("SELECT page_id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:/?/?[^ \\t\\n\\r\\f\\v]*$') AS ok FROM pages")
def format_uri_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", is_valid(df, compile_schema({"format": "uri"}, ["uri"]), "url").alias("ok"))


@query("SELECT doc_id, w, regexp_matches(w, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS ok FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE contains(w, '@')")
def format_email_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).where(F.contains("w", F.lit("@")))
    return df.select("doc_id", "w", is_valid(df, compile_schema({"format": "email"}, ["email"]), "w").alias("ok"))


@query()
def format_hostname_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").withColumn("host", F.expr("try_parse_url(url, 'HOST')"))
    return df.select("page_id", "host", is_valid(df, compile_schema({"format": "hostname"}, ["hostname"]), "host").alias("ok"))


@query("SELECT vec_id, len(embedding) >= 64 AND len(embedding) <= 64 AS size_ok, len(embedding) <= 63 AS short_ok FROM embeddings")
def array_min_max_items_embedding(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", is_valid(df, compile_schema({"minItems": 64, "maxItems": 64}), "embedding").alias("size_ok"), is_valid(df, compile_schema({"maxItems": 63}), "embedding").alias("short_ok"))


@query("SELECT vec_id, (len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3)) = 0) AS ok, len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3))::BIGINT AS bad FROM embeddings")
def array_items_bounds_embedding(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    cs = compile_schema({"items": {"type": "number", "minimum": -0.3, "maximum": 0.3}})
    checked = validate(df, cs, "embedding")
    return checked.select("vec_id", is_valid(df, cs, "embedding").alias("ok"), F.size("_errors").cast("long").alias("bad"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2)) >= 1 AS some_ok, len(list_filter(embedding, lambda x: x > 0.2)) BETWEEN 3 AND 6 AS count_ok FROM embeddings")
def array_contains_embedding(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    big = {"exclusiveMinimum": 0.2}
    return df.select("vec_id", is_valid(df, compile_schema({"contains": big}), "embedding").alias("some_ok"), is_valid(df, compile_schema({"contains": big, "minContains": 3, "maxContains": 6}), "embedding").alias("count_ok"))


@query("SELECT user_id, count(*) = count(DISTINCT CAST(floor(value) AS BIGINT)) AS ok FROM events GROUP BY 1")
def array_unique_items(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.floor("value")).alias("v"))
    return df.select("user_id", is_valid(df, compile_schema({"uniqueItems": True}), "v").alias("ok"))


@query("SELECT vec_id, embedding[1] >= 0 AND embedding[2] <= 0 AS ok FROM embeddings")
def tuple_prefix_items(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("pair", F.slice("embedding", 1, 2))
    return df.select("vec_id", is_valid(df, compile_schema({"prefixItems": [{"minimum": 0}, {"maximum": 0}], "items": False}), "pair").alias("ok"))


@query("""SELECT c_custkey, 'must have required property ''c_name''' AS message FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'must have property ''c_mktsegment'' when ''c_acctbal'' is present' FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'must be <= 20' FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey > 20""")
def required_dependent(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_nationkey"
    )
    cs = compile_schema({"required": ["c_name"], "dependentRequired": {"c_acctbal": ["c_mktsegment"]}, "dependentSchemas": {"c_mktsegment": {"properties": {"c_nationkey": {"maximum": 20}}}}})
    return explode_errors(validate(df, cs), "c_custkey").select("c_custkey", "message")


_BUILT = "CASE WHEN event_id % 5 = 0 THEN '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"x\":1}' WHEN event_id % 5 = 1 THEN '{}' ELSE props END"


def _events(spark, sf_dir) -> DataFrame:
    """Events with members added and taken away, so that keywords have something to find."""
    n = F.col("event_id") % 5
    made = F.when(n == 0, F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"x":1}'))).when(n == 1, F.lit("{}")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").withColumn("body", made).withColumn("v", F.try_parse_json("body"))


@query(f"""WITH b AS (SELECT event_id, {_BUILT} AS body FROM events)
SELECT event_id, 'must have required property ''k''' AS message, '' AS path FROM b WHERE json_extract(body, '$.k') IS NULL
UNION ALL SELECT event_id, 'must be <= 60', '/k' FROM b WHERE CAST(json_extract(body, '$.k') AS BIGINT) > 60
UNION ALL SELECT event_id, 'must NOT have additional properties', '/x' FROM b WHERE json_extract(body, '$.x') IS NOT NULL""")
def additional_properties_props(spark, sf_dir):
    df = _events(spark, sf_dir)
    return explode_errors(validate(df, compile_schema(PROPS), "v"), "event_id").drop("ord")


@query(f"""WITH b AS (SELECT event_id, {_BUILT} AS body FROM events)
SELECT event_id, coalesce(CAST(json_extract(body, '$.k') AS BIGINT) >= 50, true) AS pattern_ok, json_extract(body, '$.x') IS NULL AS names_ok, len(json_keys(body)) >= 1 AND len(json_keys(body)) <= 1 AS size_ok FROM b""")
def object_keywords_props(spark, sf_dir):
    df = _events(spark, sf_dir)
    ok = lambda s: is_valid(df, compile_schema(s), "v")
    return df.select("event_id", ok({"patternProperties": {"^k": {"minimum": 50}}}).alias("pattern_ok"), ok({"propertyNames": {"pattern": "^k$"}}).alias("names_ok"), ok({"minProperties": 1, "maxProperties": 1}).alias("size_ok"))


@query("SELECT user_id, NOT bool_or(event_type LIKE 'c%' AND n > 20) AS ok FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def pattern_properties_map(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    df = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return df.select("user_id", is_valid(df, compile_schema({"patternProperties": {"^c": {"maximum": 20}}}), "m").alias("ok"))


@query(f"""WITH b AS (SELECT event_id, {_BUILT} AS body FROM events)
SELECT event_id, json_extract(body, '$.x') IS NULL OR coalesce(CAST(json_extract(body, '$.k') AS BIGINT) >= 50, false) AS ok FROM b""")
def unevaluated_properties(spark, sf_dir):
    df = _events(spark, sf_dir)
    cs = compile_schema({"properties": {"k": True}, "anyOf": [{"properties": {"k": {"minimum": 50}, "x": True}, "required": ["k"]}, True], "unevaluatedProperties": False})
    return df.select("event_id", is_valid(df, cs, "v").alias("ok"))


@query("""SELECT o_orderkey, o_totalprice >= 50000 AND o_orderstatus = 'O' AS all_ok, o_totalprice >= 200000 OR o_orderstatus = 'F' AS any_ok,
(o_totalprice >= 200000) <> (o_orderstatus = 'F') AS one_ok, NOT (o_orderstatus = 'P') AS not_ok FROM orders""")
def composition_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    price = lambda n: {"properties": {"o_totalprice": {"minimum": n}}}
    status = lambda s: {"properties": {"o_orderstatus": {"const": s}}}
    ok = lambda s: is_valid(df, compile_schema(s))
    return df.select(
        "o_orderkey", ok({"allOf": [price(50000), status("O")]}).alias("all_ok"), ok({"anyOf": [price(200000), status("F")]}).alias("any_ok"), ok({"oneOf": [price(200000), status("F")]}).alias("one_ok"), ok({"not": status("P")}).alias("not_ok")
    )


@query("""SELECT o_orderkey, 'must be > 0' AS message FROM orders WHERE NOT o_totalprice > 0
UNION ALL SELECT o_orderkey, 'must be <= 300000' FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 'must match pattern ^[1-3]-' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
UNION ALL SELECT o_orderkey, 'must be >= 100000' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000
UNION ALL SELECT o_orderkey, 'must be <= 250000' FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 250000""")
def if_then_else_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return explode_errors(validate(df, compile_schema(ORDERS)), "o_orderkey").select("o_orderkey", "message")


@query("SELECT c_custkey, c_acctbal >= 0 AND n_regionkey BETWEEN 1 AND 3 AND length(n_name) <= 8 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ref_local_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select("c_custkey", "c_acctbal", F.struct("n_name", "n_regionkey").alias("nation"))
    cs = compile_schema({"properties": {"c_acctbal": {"$ref": "#/$defs/positive"}, "nation": {"$ref": "#nation"}}, "$defs": {"positive": {"minimum": 0}, "n": {"$anchor": "nation", "properties": {"n_regionkey": {"minimum": 1, "maximum": 3}, "n_name": {"maxLength": 8}}}}})
    return df.select("c_custkey", is_valid(df, cs).alias("ok"))


@query("SELECT event_id, event_type = 'view' OR value >= 100 AS nullable_ok, event_type <> 'view' AND value >= 100 AS strict_ok FROM events")
def nullable_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_type") != "view", F.col("value")))
    plain = {"type": "number", "minimum": 100}
    ok = lambda s: is_valid(df, compile_schema(s, null_means="null"), "x")
    return df.select("event_id", ok({**plain, "nullable": True}).alias("nullable_ok"), ok(plain).alias("strict_ok"))


_TREE = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer", "maximum": 80}, "next": {"$ref": "#/$defs/node"}}, "required": ["v"]}}}


@query("""WITH b AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'must be <= 80' AS message, p AS path FROM b, (VALUES ('/v', 0), ('/next/v', 10), ('/next/next/v', 20)) AS x(p, d) WHERE k + d > 80""")
def recursive_ref_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    df = table(spark, sf_dir, "events").select("event_id", F.format_string('{"v":%d,"next":{"v":%d,"next":{"v":%d}}}', k, k + 10, k + 20).alias("j"))
    return explode_errors(validate_json(df, compile_schema(_TREE), "j"), "event_id").drop("ord")


# ---------------------------------------------------------------- parsing


@query(f"""WITH b AS (SELECT event_id, {_BUILT} AS body FROM events)
SELECT event_id, coalesce(CASE WHEN CAST(json_extract(body, '$.k') AS BIGINT) <= 60 THEN CAST(json_extract(body, '$.k') AS BIGINT) END, 7) AS k, coalesce(CAST(json_extract(body, '$.x') AS VARCHAR), 'none') AS x FROM b""")
def parse_events_props(spark, sf_dir):
    cs = compile_schema({"type": "object", "properties": {"k": {"type": "integer", "maximum": 60, "default": 7}, "x": {"type": "string", "default": "none"}}, "required": ["k", "x"]})
    return parse(_events(spark, sf_dir), cs, "body").select("event_id", "parsed.k", "parsed.x")


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 200000 THEN o_totalprice ELSE 5.0 END AS o_totalprice, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'O' END AS o_orderstatus FROM orders")
def parse_defaults_orders(spark, sf_dir):
    cs = compile_schema({"type": "object", "properties": {"o_orderkey": {"type": "integer"}, "o_totalprice": {"type": "number", "minimum": 5, "maximum": 200000}, "o_orderstatus": {"enum": ["O", "F"]}}, "required": ["o_orderkey", "o_totalprice", "o_orderstatus"]})
    return parse(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), cs)


@query("SELECT o_orderkey, CASE upper(o_orderpriority) WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' ELSE '1-Urgent' END AS p FROM orders")
def parse_case_insensitive_enum(spark, sf_dir):
    cs = compile_schema({"type": "object", "properties": {"p": {"enum": ["1-Urgent", "2-High"]}}, "required": ["p"]})
    return parse(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p")), cs, case_insensitive=True)


@query(f"SELECT ({_LINE_OK}) AS accepted, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def parse_strict_split(spark, sf_dir):
    df = parse(table(spark, sf_dir, "lineitem"), compile_schema(LINEITEM), strict=True)
    return df.groupBy((F.size("_errors") == 0).alias("accepted")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_id, event_type FROM events")
def strip_unknown(spark, sf_dir):
    cs = compile_schema({"type": "object", "properties": {"event_id": {"type": "integer"}, "event_type": {"type": "string"}}, "required": ["event_id", "event_type"]})
    return parse(table(spark, sf_dir, "events"), cs, strip_unknown=True)


@query(f"WITH b AS (SELECT event_id, {_BUILT} AS body FROM events) SELECT event_id, 'x' AS unknown FROM b WHERE json_extract(body, '$.x') IS NOT NULL")
def unknown_key_warnings(spark, sf_dir):
    df = _events(spark, sf_dir)
    return df.select("event_id", F.explode(unknown_keys(df, compile_schema(PROPS), "body")).alias("unknown"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN value <= 300 WHEN 'view' THEN value >= 20 WHEN 'purchase' THEN true ELSE false END AS ok FROM events")
def discriminated_union_events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    kind = lambda t, v: {"properties": {"event_type": {"const": t}, "value": v}}
    return df.select("event_id", is_valid(df, compile_schema({"oneOf": [kind("click", {"maximum": 300}), kind("view", {"minimum": 20}), kind("purchase", {})]})).alias("ok"))


# ---------------------------------------------------------------- document queries

_NESTED = "'{\"a\":{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},\"list\":[{\"n\":' || event_id % 4 || '},{\"n\":' || event_id % 9 || '},{\"n\":5}]}'"


def _nested(spark, sf_dir) -> DataFrame:
    made = F.format_string('{"a":{"k":%s},"list":[{"n":%d},{"n":%d},{"n":5}]}', F.get_json_object("props", "$.k"), F.col("event_id") % 4, F.col("event_id") % 9)
    return table(spark, sf_dir, "events").select("event_id", made.alias("doc"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '5' AS last FROM events")
def jsonpath_child(spark, sf_dir):
    df = _nested(spark, sf_dir)
    return df.select("event_id", child("doc", "$.a.k").cast("long").alias("k"), child("doc", "$['list'][2].n").alias("last"))


@query("SELECT event_id, i AS ord, '$[''list''][' || i || '][''n'']' AS path, CAST(v AS VARCHAR) AS value FROM events, (VALUES (0, 4), (1, 9), (2, 0)) AS x(i, m), LATERAL (SELECT CASE WHEN m = 0 THEN 5 ELSE event_id % m END AS v)")
def jsonpath_wildcard(spark, sf_dir):
    return jsonpath(_nested(spark, sf_dir), "doc", "$.list[*].n", "event_id").select("event_id", "ord", "path", "value")


@query("SELECT event_id, 0 AS ord, '/list/2' AS pointer, '{\"n\":5}' AS value FROM events UNION ALL SELECT event_id, 1, '/list/1', '{\"n\":' || event_id % 9 || '}' FROM events")
def jsonpath_slice(spark, sf_dir):
    return jsonpath(_nested(spark, sf_dir), "doc", "$.list[2:0:-1]", "event_id").select("event_id", "ord", "pointer", "value")


@query(f"SELECT event_id, count(*) AS n FROM (SELECT event_id, unnest(json_extract({_NESTED}, '$..n')) AS v FROM events) GROUP BY 1")
def jsonpath_descent(spark, sf_dir):
    return jsonpath(_nested(spark, sf_dir), "doc", "$..n", "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, '/list/' || i AS pointer FROM events, (VALUES (0, 4), (1, 9), (2, 0)) AS x(i, m) WHERE CASE WHEN m = 0 THEN 5 ELSE event_id % m END > 2")
def jsonpath_filter(spark, sf_dir):
    return jsonpath(_nested(spark, sf_dir), "doc", "$.list[?(@.n > 2 && @property !== 'x')]", "event_id").select("event_id", "pointer")


@query("SELECT event_id, '\"k\"' AS key, '/a' AS parent FROM events")
def jsonpath_parent_keys(spark, sf_dir):
    df = _nested(spark, sf_dir)
    keys = jsonpath(df, "doc", "$.a.*~", "event_id").select("event_id", F.col("value").alias("key"))
    return keys.join(jsonpath(df, "doc", "$.a.k^", "event_id").select("event_id", F.col("pointer").alias("parent")), "event_id")


# ---------------------------------------------------------------- rules


@query("""SELECT p_partkey, code, message FROM (
SELECT p_partkey, 'name-truthy' AS code, '"p_name" must be truthy' AS message FROM part WHERE p_name = ''
UNION ALL SELECT p_partkey, 'size-enum', '"' || p_size || '" must be equal to one of the allowed values: 1, 2, 3' FROM part WHERE p_size NOT IN (1, 2, 3)
UNION ALL SELECT p_partkey, 'brand-length', 'must not be longer than 7' FROM part WHERE length(p_brand) > 7
UNION ALL SELECT p_partkey, 'type-pattern', '"' || p_type || '" must match the pattern "/^promo/i"' FROM part WHERE NOT regexp_matches(p_type, '(?i)^promo'))""")
def rules_part(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    checks = [
        ("name-truthy", "warn", "/p_name", R.truthy(F.col("p_name"), T.StringType(), "p_name")),
        ("size-enum", "error", "/p_size", R.enumeration(F.col("p_size"), [1, 2, 3])),
        ("brand-length", "info", "/p_brand", R.length(F.col("p_brand"), T.StringType(), high=7)),
        ("type-pattern", "hint", "/p_type", R.pattern(F.col("p_type"), match="/^promo/i")),
    ]
    return L.lint_columns(df, checks, "p_partkey").select("p_partkey", "code", "message")


_CASES = {
    "flat": "^[a-z][a-z0-9]*$", "camel": "^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)*[A-Z]?$", "pascal": "^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]+)*[A-Z]?$", "kebab": "^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$",
    "cobol": "^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*$", "snake": "^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$", "macro": "^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$",
}


@query("SELECT DISTINCT t, " + ", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in _CASES.items()) + " FROM (SELECT r_name AS t FROM region UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT replace(n_name, ' ', '_') FROM nation UNION ALL SELECT p_brand FROM part UNION ALL SELECT lower(o_orderpriority) FROM orders)")
def rule_casing(spark, sf_dir):
    part = lambda n, c: table(spark, sf_dir, n).select(c.alias("t"))
    df = part("region", F.col("r_name")).union(part("nation", F.lower("n_name"))).union(part("nation", F.replace("n_name", F.lit(" "), F.lit("_")))).union(part("part", F.col("p_brand"))).union(part("orders", F.lower("o_orderpriority"))).distinct()
    return df.select("t", *(R.casing(F.col("t"), k).isNull().alias(k) for k in _CASES))


@query("SELECT n_regionkey, n_name, coalesce(lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > n_name, false) AS bad FROM nation")
def rule_alphabetical(spark, sf_dir):
    before = F.lag("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_name", R.out_of_order(before, F.col("n_name")).alias("bad"))


@query("SELECT c_custkey, NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS or_ok, (c_acctbal >= 0) <> (c_mktsegment <> 'BUILDING') AS xor_ok, NOT (c_acctbal >= 0 AND c_mktsegment <> 'BUILDING') AS most_ok FROM customer")
def rule_presence(spark, sf_dir):
    a, b = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.nullif("c_mktsegment", F.lit("BUILDING"))
    names = ["a", "b"]
    return table(spark, sf_dir, "customer").select("c_custkey", R.at_least_one(names, a, b).isNull().alias("or_ok"), R.exactly_one(names, a, b).isNull().alias("xor_ok"), R.at_most_one(names, a, b).isNull().alias("most_ok"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unreferenced_part(spark, sf_dir):
    return L.unreferenced(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_partkey").select("p_partkey")


@query("SELECT 'order' AS side, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def tag_defined_orders_customer(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lost = L.unreferenced(o, "o_custkey", c, "c_custkey").select(F.lit("order").alias("side"), F.col("o_orderkey").alias("id"))
    return lost.union(L.unreferenced(c, "c_custkey", o, "o_custkey").select(F.lit("customer"), "c_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r > 1")
def unique_operation_id(spark, sf_dir):
    return L.later_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT path, message, count(*) AS n FROM ({_LINE_SQL}) GROUP BY 1, 2")
def findings_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return summary(explode_errors(validate(df, compile_schema(LINEITEM)), "l_orderkey"), "path", "message")


@query(f"SELECT l_suppkey, path, count(*) AS n FROM ({_LINE_SQL}) GROUP BY ROLLUP (l_suppkey, path)")
def findings_rollup(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return explode_errors(validate(df, compile_schema(LINEITEM)), "l_suppkey").rollup("l_suppkey", "path").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, path, message FROM ({_LINE_SQL}) ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey, path, message LIMIT 50")
def findings_ordered_top(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = explode_errors(validate(df, compile_schema(LINEITEM)), *LINE_KEY)
    return found.orderBy(F.desc("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "path", "message").limit(50).drop("ord")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 0 WHEN source LIKE 'src1%' THEN 3 ELSE 1 END AS severity FROM documents WHERE length(text) > 3000 AND source <> 'src2'")
def severity_overrides(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    own = F.when(glob_match(F.col("source"), "src2"), F.lit(-1)).when(glob_match(F.col("source"), "src1"), F.lit(0)).when(glob_match(F.col("source"), "src1*"), F.lit(3)).otherwise(F.lit(1))
    found = L.lint_columns(df.withColumn("own", own), [("long", "warn", "/text", R.length(F.col("text"), T.StringType(), high=3000))], "doc_id", "own")
    return found.where("own >= 0").select("doc_id", F.col("own").alias("severity"))


@query("SELECT doc_id, 'Document ' || doc_id || ' in ' || lang || ' at /text: ' || length(text) || ' characters ()' AS message FROM documents")
def message_template(spark, sf_dir):
    text = R.message("Document {{property}} in {{value}} at {{path}}: {{error}} characters ({{nothing}})", property=F.col("doc_id"), value=F.col("lang"), path=F.lit("/text"), error=F.char_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("message"))


@query("SELECT id, parent, cyclic FROM (VALUES ('a', 'b', true), ('b', 'c', true), ('c', 'a', true), ('d', 'a', false), ('e', 'zz', false)) AS t(id, parent, cyclic)")
def parent_cycle(spark, sf_dir):
    tags = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "zz")]
    spark.createDataFrame(tags, "id string, parent string").createOrReplaceTempView("tessera_tags")
    return spark.sql("""WITH RECURSIVE up(id, parent, at, n) AS (
        SELECT id, parent, parent, 1 FROM tessera_tags
        UNION ALL SELECT up.id, up.parent, t.parent, n + 1 FROM up JOIN tessera_tags t ON t.id = up.at WHERE up.at <> up.id AND n < 10)
        SELECT id, parent, max(at = id) AS cyclic FROM up GROUP BY id, parent""")


# ---------------------------------------------------------------- contracts

ROUTES = [C.Route("root", "GET", "/"), C.Route("language", "GET", "/{lang}"), C.Route("page", "GET", "/{lang}/{id}"), C.Route("rest", "GET", "/{lang}/{tail+}")]
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/$', '\\1')"


@query(f"""SELECT page_id, CASE WHEN p = '/' THEN 'root' WHEN regexp_matches(p, '^/[^/]+$') THEN 'language' WHEN regexp_matches(p, '^/[^/]+/[^/]+$') THEN 'page' WHEN regexp_matches(p, '^/[^/]+/.+$') THEN 'rest' END AS route,
CASE WHEN regexp_matches(p, '^/[^/]+/[^/]+$') THEN regexp_extract(p, '^/[^/]+/([^/]+)$', 1) END AS id FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def route_match_pages(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    hit = C.route_match(F.lit("get"), path, ROUTES)
    return table(spark, sf_dir, "pages").select("page_id", hit["route"].alias("route"), F.try_element_at(hit["params"], F.lit("id")).alias("id"))


@query("""SELECT page_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN v IS NOT NULL THEN '"' || v || '"' END AS page, r AS ref FROM (
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS v, CASE WHEN regexp_matches(url, '[?&]ref=') THEN '["' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) || '"]' END AS r FROM pages)""")
def query_coercion_pages(spark, sf_dir):
    plan = C.coercion_plan({"properties": {"page": {"type": "integer"}, "ref": {"type": "array", "items": {"type": "string"}}}})
    pairs = C.query_pairs(F.regexp_extract("url", r"\?([^#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", *(C.query_value(pairs, k, plan[k]).alias(k) for k in plan))


_ACCEPTS = (
    (1, "application/json", "application/json"), (2, "text/*;q=0.5, application/json;q=0.1", "text/csv"), (3, "*/*", "application/json"), (4, "application/json;q=0, */*", "text/csv"),
    (5, "image/png", None), (6, "", "application/json"), (7, "TEXT/CSV;q=0.9,application/json;q=x", "application/json"), (8, None, "application/json"), (9, "text/csv;q=0", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if c is None else chr(39) + c + chr(39)})" for i, _, c in _ACCEPTS) + ") AS t(id, chosen)")
def media_negotiation(spark, sf_dir):
    df = spark.createDataFrame([(i, a) for i, a, _ in _ACCEPTS], "id int, accept string")
    return df.select("id", C.negotiate(F.col("accept"), ["application/json", "text/csv"]).alias("chosen"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, ts, i, ts AS opened, 1 AS hit FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN e.ts >= w.opened + INTERVAL 1 DAY THEN e.ts ELSE w.opened END, CASE WHEN e.ts >= w.opened + INTERVAL 1 DAY THEN 1 ELSE w.hit + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, CAST(hit AS BIGINT) AS hit, hit <= 2 AS allowed FROM w""")
def rate_limit_events(spark, sf_dir):
    return C.rate_windows(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 86_400, "event_id").select("event_id", "user_id", "hit", "allowed")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN event_type NOT IN ('click', 'view') THEN 'unknown-type' WHEN event_type = 'click' AND k > 60 THEN 'invalid-payload' END AS reason
FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def message_contract_events(spark, sf_dir):
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("[1")).otherwise(F.format_string('{"type":"%s","k":%s}', F.col("event_type"), F.get_json_object("props", "$.k")))
    contract = {"click": compile_schema(PROPS), "view": compile_schema({"type": "object"})}
    return table(spark, sf_dir, "events").select("event_id", C.message_reason(raw, contract)["reason"].alias("reason"))


@query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'id: ' || conv_id || '-' || turn || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def sse_format_conversations(spark, sf_dir):
    frame = C.sse(data=F.col("text"), event=F.col("role"), event_id=F.concat_ws("-", "conv_id", "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", frame.alias("frame"))


@query()
def fnv1a_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.fnv1a_hex(F.col("source")).alias("hash"))


@query("SELECT event_id, event_id % 4 = 0 AS same FROM events")
def frame_round_trip(spark, sf_dir):
    body = F.encode("props", "UTF-8")
    two = F.concat(C.frame(F.lit(1), body), C.frame(F.col("event_id") % 4, body))
    got = C.unframe(two)
    return table(spark, sf_dir, "events").select("event_id", ((F.size(got) == 2) & (got[1]["kind"] == 0) & (got[1]["payload"] == body)).alias("same"))


# ---------------------------------------------------------------- generators, types, documents


@query("SELECT DISTINCT l_extendedprice AS x, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END AS t FROM lineitem")
def number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), js_number_text(F.col("l_extendedprice")).alias("t")).distinct()


USER = {
    "type": "object", "additionalProperties": False, "required": ["id", "name", "age"],
    "properties": {"id": {"type": "string", "format": "uuid"}, "name": {"type": "string", "minLength": 1, "maxLength": 80}, "age": {"type": "integer", "minimum": 0, "maximum": 130}, "active": {"type": "boolean"}},
}


@query("SELECT count(*) AS n, true AS all_valid FROM range(200)")
def generate_rows_valid(spark, sf_dir):
    cs = compile_schema(USER, "all")
    df = generate(spark, cs, 200, seed=7)
    return df.agg(F.count("*").alias("n"), F.every(is_valid(df, cs, "value")).alias("all_valid"))


@query()
def example_rows(spark, sf_dir):
    return example_row(spark, compile_schema(USER, "all"))


@query("SELECT * FROM (VALUES ('id', 'string', false), ('name', 'string', false), ('age', 'bigint', false), ('active', 'boolean', true)) AS t(name, kind, nullable)")
def struct_type_fields(spark, sf_dir):
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in struct_type(USER).fields], "name string, kind string, nullable boolean")


_YAML = "a: 1\nb: [x, 0x1F, ~, true]\nc: &r {d: 1.5}\ne: *r\n---\n- second\n"


@query("""SELECT * FROM (VALUES (0, '', 'object', NULL), (0, '/a', 'number', '1'), (0, '/b', 'array', NULL), (0, '/b/0', 'string', '"x"'), (0, '/b/1', 'number', '31'), (0, '/b/2', 'null', 'null'), (0, '/b/3', 'boolean', 'true'),
(0, '/c', 'object', NULL), (0, '/c/d', 'number', '1.5'), (0, '/e', 'object', NULL), (0, '/e/d', 'number', '1.5'), (1, '', 'array', NULL), (1, '/0', 'string', '"second"')) AS t(doc_index, pointer, kind, value)""")
def yaml_parse_nodes(spark, sf_dir):
    return node_table(spark.createDataFrame([("m.yaml", _YAML)], "source string, text string")).select("doc_index", "pointer", "kind", "value")


@query("SELECT * FROM (VALUES ('~', 'null'), ('Yes', 'string'), ('TRUE', 'boolean'), ('0o17', 'integer'), ('-3', 'integer'), ('1e3', 'number'), ('.inf', 'number'), ('1_000', 'string'), ('', 'null')) AS t(x, kind)")
def yaml_scalar_typing(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("~", "Yes", "TRUE", "0o17", "-3", "1e3", ".inf", "1_000", "")], "x string")
    return df.select("x", plain_scalar_kind(F.col("x")).alias("kind"))


_DOC = {"a": {"$ref": "#/$defs/x"}, "b": {"c": [{"$ref": "#/a"}]}, "enum": [{"$ref": "#/none"}], "$defs": {"x": {"type": "string"}, "loop": {"properties": {"n": {"$ref": "#/$defs/loop"}}}}}


@query("SELECT * FROM (VALUES ('/a', '#/$defs/x'), ('/b/c/0', '#/a'), ('/$defs/loop/properties/n', '#/$defs/loop')) AS t(\"from\", \"to\")")
def resolve_refs_edges(spark, sf_dir):
    return ref_edges(spark.createDataFrame([("d", json.dumps(_DOC))], "source string, text string")).select("from", "to")


@query()
def resolve_refs_document(spark, sf_dir):
    out, errors, origins = resolve(_DOC)
    return spark.createDataFrame([(json.dumps(out), json.dumps(errors), json.dumps(origins))], "document string, errors string, origins string")


_API = {
    "openapi": "3.1.0", "info": {"title": "x", "version": "1"}, "tags": [{"name": "b"}, {"name": "a"}, {"name": "a"}],
    "paths": {"/a/{id}/": {"get": {"operationId": "q", "tags": ["zz"], "responses": {"400": {}}}}}, "components": {"schemas": {"U": {"type": "string", "enum": ["a", "a", 3]}}},
}
_FOUND = (
    "duplicated-entry-in-enum", "info-contact", "info-description", "openapi-tags-uniqueness", "operation-description", "operation-success-response", "operation-tag-defined", "path-keys-no-trailing-slash",
    "path-params", "typed-enum", "oas3-api-servers", "oas3-unused-component",
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _FOUND) + ") AS t(code)")
def openapi_rules(spark, sf_dir):
    df = spark.createDataFrame([("api.json", json.dumps(_API))], "source string, text string")
    return L.lint(df, {"extends": [openapi_ruleset()]}).select("code")


@query("SELECT 'api.json' AS source, 3 AS passes, true AS converged")
def fix_convergence(spark, sf_dir):
    df = spark.createDataFrame([("api.json", json.dumps(_API))], "source string, text string")
    return L.fix(df, {"extends": [[openapi_ruleset(), "all"]]}).select("source", "passes", "converged")


#: Hosts and whether they are private, by the ranges of the address registries.
_HOSTS = {
    "127.0.0.1": True, "10.1.2.3": True, "::1": True, "example.com": False, "8.8.8.8": False, "localhost": True, "::ffff:192.168.1.1": True, "2130706433": True, "0x7f000001": True, "127.1": True, "0177.0.0.1": True,
    "metadata": True, "instance-data": True, "metadata.goog": True, "a.internal": True, "100.64.0.1": True, "100.128.0.1": False, "fec0::1": True, "fe80::1": True, "fd00::1": True, "::7f00:1": True, "64:ff9b::a00:1": True,
    "2606:4700::1111": False, "192.0.0.8": True, "192.0.1.8": False, "198.19.0.1": True, "256.1.1.1": False, "1.2.3": False, "a.local": False, "255.255.255.255": True, "[::1]": True, "localhost.": True, "09.1.1.1": False,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {str(p).lower()})" for h, p in _HOSTS.items()) + ") AS t(host, private)")
def private_hosts(spark, sf_dir):
    df = spark.createDataFrame([(h,) for h in _HOSTS], "host string")
    return df.select("host", is_private_host(F.col("host")).alias("private"))
