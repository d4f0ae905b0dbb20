"""Interpreter, compiler, parsers and transforms against the definitions and against each other."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.formats import UnsupportedPattern, format_ok, java_pattern, js_number, js_number_from_text, js_number_text, risky
from tessera.functions.interpreter import SchemaError, Validator, canonical
from tessera.operators.validate import UnsupportedSchema, assert_valid, compile_schema, errors, is_valid, split, validate, validate_json
from tessera.plans.defaults import default_of, example_of, merge_all
from tessera.plans.parsing import extended, parse
from tessera.plans.types import from_type, struct_type

ORDER = {
    "type": "object", "additionalProperties": False, "required": ["id", "status", "total", "items"],
    "properties": {
        "id": {"type": "string", "minLength": 2}, "status": {"enum": ["pending", "paid"]}, "total": {"type": "number", "minimum": 0},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "string", "minLength": 1}, "qty": {"type": "integer", "minimum": 1}}}},
        "tags": {"type": "array", "uniqueItems": True, "contains": {"const": "a"}}, "a/b": {"maximum": 3},
    },
    "patternProperties": {"^x_": {"type": "number"}},
    "dependentRequired": {"tags": ["a/b"]},
}
SCHEMAS = [
    ORDER,
    {"anyOf": [{"type": "string", "pattern": "^a"}, {"type": "number", "multipleOf": 0.1}]},
    {"oneOf": [{"minimum": 2}, {"maximum": 5}, {"type": "null"}]},
    {"if": {"type": "object", "required": ["k"]}, "then": {"properties": {"k": {"type": "integer"}}}, "else": {"not": {"type": "boolean"}}},
    {"properties": {"k": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"type": ["integer", "null"], "exclusiveMaximum": 9}}, "propertyNames": {"maxLength": 3}, "minProperties": 1},
    {"prefixItems": [{"type": "integer"}, {"const": {"a": [1, "x"]}}], "items": {"type": "string"}, "maxItems": 4},
    {"enum": [1, "1", None, [1, 2], {"a": 1.0}]},
    {"properties": {"a": True}, "allOf": [{"properties": {"b": True}}, {"patternProperties": {"^z": {"minimum": 1}}}], "unevaluatedProperties": False},
    {"type": "object", "nullable": True, "maxProperties": 1},
    False,
]


def values(seed, n):
    r = random.Random(seed)

    def one(d=0):
        k = r.randint(0, 8 if d < 3 else 5)
        if k == 0:
            return None
        if k == 1:
            return r.random() < 0.5
        if k == 2:
            return r.choice([0, 1, 2, 3, 4, 9, -1, 10])
        if k == 3:
            return r.choice([0.5, 1.0, 0.3, 2.5, -0.1, 0.30000000000000004])
        if k in (4, 5):
            return r.choice(["", "a", "ab", "1", "paid", "pending", "b"])
        if k == 6:
            return [one(d + 1) for _ in range(r.randint(0, 4))]
        return {r.choice(["id", "status", "total", "items", "tags", "a/b", "x_1", "k", "sku", "qty", "a", "b", "zz", "long"]): one(d + 1) for _ in range(r.randint(0, 5))}

    good = {"id": "ab", "status": "paid", "total": 1.5, "items": [{"sku": "s", "qty": 2}]}
    return [one() for _ in range(n)] + [good, {**good, "tags": ["a", "a"]}, {**good, "x_1": "s", "items": []}, {**good, "items": [{"qty": 0}, 3]}, {"a": 1.0}, {"a": 1}, [1, 2], [1, {"a": [1, "x"]}, "s"]]


def test_compiled_variants_agree_with_the_interpreter(spark):
    own = values(3, 250)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(own)], "i int, t string").withColumn("v", F.parse_json("t")).repartition(1)
    sample = [compile_schema(s) for s in SCHEMAS]
    cols = [c for k, cs in enumerate(sample) for c in (is_valid(df, cs, "v").alias(f"ok{k}"), errors(df, cs, "v").alias(f"e{k}"))]
    rows = []
    for at in range(0, len(cols), 4):
        rows.append(df.select("i", *cols[at : at + 4]).collect())
    for part in rows:
        for r in part:
            for k, s in enumerate(SCHEMAS):
                if f"ok{k}" in r:
                    want = Validator(s).errors(own[r.i])
                    assert r[f"ok{k}"] == (not want), (s, own[r.i], want)
                    key = lambda e: (e["path"], e["message"])
                    assert sorted((e.asDict() for e in r[f"e{k}"]), key=key) == sorted(want, key=key), (s, own[r.i])


def test_typed_columns_agree_with_the_interpreter(spark):
    t = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("k", T.LongType()), T.StructField("xs", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.DoubleType()))])
    rows = [("ab", 1.5, 3, [1, 2, 2], {"a": 1.0, "x": 2.0}), (None, None, None, None, None), ("", float("nan"), -1, [], {}), ("a\n", float("inf"), 10, [None, 5], {"x": None}), ("é" * 3, 0.3, 7, [9], {"b": 0.0})]
    df = spark.createDataFrame(rows, t)
    schema = {
        "required": ["n"], "properties": {"id": {"pattern": "^a$", "minLength": 1}, "n": {"type": "integer"}, "k": {"minimum": 0, "multipleOf": 2}, "xs": {"uniqueItems": True, "items": {"type": "integer", "maximum": 8}, "contains": {"minimum": 2}}, "m": {"additionalProperties": {"minimum": 1}}},
    }
    got = [{(e.path, e.message) for e in r._errors} for r in validate(df, compile_schema(schema)).select("_errors").collect()]
    for row, g in zip(rows, got, strict=True):
        value = {k: v for k, v in zip(t.names, row, strict=True) if v is not None}
        assert g == {(e["path"], e["message"]) for e in Validator(schema).errors(value)}
    assert is_valid(df, compile_schema({"type": "object", "nullable": True}), "id") is not None


def test_interpreter_on_scopes_and_limits():
    tree = {"$id": "http://x/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"c": {"type": "array", "items": {"$dynamicRef": "#node"}}, "d": True}}
    strict = {"$id": "http://x/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False}
    own = Validator(strict, documents={"http://x/tree": tree})
    assert own.ok({"c": [{"d": 1}]}) and not own.ok({"c": [{"e": 1}]})
    assert Validator({"items": {"type": "integer"}, "unevaluatedItems": False}).ok([1])
    assert not Validator({"prefixItems": [True], "unevaluatedItems": False}).ok([1, 2])
    with pytest.raises(SchemaError):
        Validator({"$ref": "#/nothing"}).ok(1)
    with pytest.raises(SchemaError):
        Validator({"type": "text"}).ok(1)
    deep = []
    for _ in range(600):
        deep = [deep]
    with pytest.raises(SchemaError):
        Validator({"items": {"$ref": "#"}}).ok(deep)


def test_slow_path_takes_what_cannot_be_compiled(spark):
    schema = {"properties": {"n": {"$ref": "#"}, "v": {"maximum": 3}}}
    with pytest.raises(UnsupportedSchema):
        compile_schema(schema).compiler().valid(F.lit(None), T.VariantType())
    df = spark.createDataFrame([(1, '{"n":{"n":{"v":9}}}'), (2, "nope"), (3, None), (4, '{"v":1,"v":9}')], "i int, t string")
    got = {r.i: [(e.path, e.message) for e in r._errors] for r in validate_json(df, compile_schema(schema), "t").collect()}
    assert got == {1: [("/n/n/v", "must be <= 3")], 2: [("", "must be JSON")], 3: [], 4: [("/v", "must be <= 3")]}
    good, bad = split(df.withColumn("v", F.try_parse_json("t")), compile_schema({"type": "object"}), "v")
    assert {r.i for r in bad.collect()} == set() and good.count() == 4
    with pytest.raises(Exception, match="must be string"):
        assert_valid(df, compile_schema({"properties": {"i": {"type": "string"}}})).collect()


def test_formats_patterns_and_numbers(spark):
    assert format_ok("ipv6", "::ffff:1.2.3.4") and not format_ok("ipv6", "1::2::3") and not format_ok("ipv4", "01.2.3.4")
    assert format_ok("date-time", "2024-02-30T23:59:60Z") and not format_ok("date-time", "2024-02-30T23:59:60")
    assert format_ok("duration", "P1DT2H") and not format_ok("duration", "P") and format_ok("regex", "^a+$") and not format_ok("regex", "(")
    assert not format_ok("hostname", "-a.b") and format_ok("hostname", "a-b.c") and format_ok("unknown", "x")
    df = spark.createDataFrame([("a\n",), ("a",), ("&",), ("x[y",)], "t string")
    got = df.select(F.col("t").rlike(java_pattern("^a$")).alias("a"), F.col("t").rlike(java_pattern("[a&&b]")).alias("b"), F.col("t").rlike(java_pattern("[[]")).alias("c")).collect()
    assert [r.a for r in got] == [False, True, False, False] and [r.b for r in got] == [True, True, True, False] and got[3].c
    with pytest.raises(UnsupportedPattern):
        java_pattern("[")
    assert risky("(a+)+") and risky("(a|a)*") and not risky("a+b*")
    xs = [0.0, 1.0, -2.5, 123456789.5, 1e21, 1.5e-7, 0.000001, 1e20, -0.0, 1e300, float("inf")]
    got = [r.t for r in spark.createDataFrame([(x,) for x in xs], "x double").select(js_number_text(F.col("x")).alias("t")).collect()]
    assert got == [js_number(x) for x in xs] == ["0", "1", "-2.5", "123456789.5", "1e+21", "1.5e-7", "0.000001", "100000000000000000000", "0", "1e+300", "Infinity"]
    texts = {"": 0.0, " 12 ": 12.0, "0x10": 16.0, "1d": None, "1e3": 1000.0, ".5": 0.5, "abc": None, "0b11": 3.0, "-Infinity": float("-inf"), "1_0": None}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", js_number_from_text(F.col("t")).alias("n")).collect()}
    assert got == texts
    assert canonical({"b": 1.0, "a": [True, None]}) == canonical({"a": [True, None], "b": 1})


def test_parsers(spark):
    schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": 2}, "s": {"type": "string", "default": "d"}, "b": {"type": "boolean"}, "e": {"enum": ["Red", "Blue"]}, "xs": {"type": "array", "items": {"type": "integer"}}}, "required": ["n", "s", "b", "e", "xs"]}
    df = spark.createDataFrame([('{"n":"0x10","s":1.0,"b":"false","e":"blue","xs":["3",4.0]}',), ("[]",), (None,), ('{"n":1,"b":0}',)], "t string")
    got = [r.parsed.asDict() if r.parsed else None for r in parse(df, compile_schema(schema), "t", case_insensitive=True).collect()]
    assert got[0] == {"n": 16.0, "s": "1", "b": True, "e": "Blue", "xs": [3, 4]}
    assert got[3] == {"n": 2.0, "s": "d", "b": False, "e": "Red", "xs": []}
    wide = spark.createDataFrame([(1, "x", 5)], "n int, s string, extra int")
    assert parse(wide, compile_schema(schema), strip_unknown=True).columns == ["n", "s", "b", "e", "xs"]
    assert parse(wide, compile_schema(schema)).columns == ["extra", "n", "s", "b", "e", "xs"]
    assert extended({"properties": {}}, {"": {"z": {}}})["properties"] == {"z": {}}


def test_parsers_of_nested_json_compile_and_keep_open_members(spark):
    point = {"type": "object", "properties": {"z": {"type": "number", "minimum": 2}}}
    schema = {"type": "object", "properties": {"k": {"type": "integer"}, "o": {"type": "object", "properties": {"a": {"type": "integer"}, "p": point}, "additionalProperties": True}}}
    df = spark.createDataFrame([('{"k":"3","o":{"a":2.0,"p":{"z":"0x10"},"q":[1]}}',), ('{"k":1.5,"o":{"p":{"z":1}}}',), ('{"o":[]}',), ("nope",), (None,)], "t string")
    spark.conf.set("spark.sql.codegen.fallback", "false")  # too large an expression fails
    try:
        got = [r.asDict() for r in parse(df, compile_schema(schema), "t").select("parsed.k", "parsed.o.a", "parsed.o.p.z", F.to_json("parsed.o._extra").alias("extra")).collect()]
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")
    assert got[0] == {"k": 3, "a": 2, "z": 16.0, "extra": '{"q":[1]}'}
    assert got[1]["k"] == 0 and got[1]["a"] is None and got[1]["z"] == 2.0 and got[1]["extra"] == "{}"
    assert [r["z"] for r in got[2:]] == [None] * 3


def test_types_defaults_and_examples():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "title": "A"}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"$ref": "#/$defs/c"}, "d": {"enum": ["x", None]}, "e": {"x-type": {"primitive": "bigint"}}}, "$defs": {"c": {"type": "object", "properties": {"again": {"$ref": "#/$defs/c"}}}}}
    t = struct_type(schema)
    assert t["a"].dataType == T.LongType() and not t["a"].nullable and t["a"].metadata["comment"] == "A"
    assert t["b"].dataType == T.ArrayType(T.DoubleType()) and t["c"].dataType["again"].dataType == T.VariantType() and t["e"].dataType == T.DecimalType(38, 0)
    back, notes = from_type(T.StructType([T.StructField("x", T.LongType(), False), T.StructField("y", T.BinaryType())]))
    assert back["required"] == ["x"] and notes
    with pytest.raises(ValueError):
        from_type(T.BinaryType(), strict=True)
    assert default_of({"type": "integer", "minimum": 5, "multipleOf": 4}) == 8 and default_of({"type": "array", "minItems": 2, "items": {"const": 1}}) == [1, 1]
    assert merge_all({"minimum": 1, "type": ["integer", "string"]}, {"minimum": 3, "type": "number"}) == {"minimum": 3, "type": "integer"}
    for s in (ORDER, {"type": "string", "pattern": "^[0-9]{5}$"}, {"type": "array", "minItems": 3, "uniqueItems": True, "items": {"type": "string"}}, {"allOf": [{"minimum": 3}, {"type": "integer", "maximum": 9}]}, {"type": "string", "format": "uuid"}):
        assert Validator(s, "all").ok(example_of(s)), s


def test_generate_raises_when_too_few_candidates_are_valid(spark):
    from tessera.operators.generate import generate
    from tessera.operators.validate import compile_schema

    some = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 1000, "not": {"minimum": 2}}}}
    with pytest.raises(ValueError, match="candidates are valid"):
        generate(spark, compile_schema(some), 50)
