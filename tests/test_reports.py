import pytest
from pyspark.sql import functions as F

from tessera.operators.contract import Route
from tessera.plans.metaschema import documents, schema_errors
from tessera.functions.interpreter import Validator
from tessera.sources.reports import between_markers, contract_hash, form_parts, markdown, multipart_parts, not_modified, openapi_document, property_table


def test_metaschema():
    assert not schema_errors({"type": "object", "properties": {"a": {"minimum": 1, "items": {"type": ["string", "null"]}}}})
    assert {e["path"] for e in schema_errors({"properties": {"a": {"minimum": "1", "pattern": "("}}, "required": "a"})} == {"/properties/a/minimum", "/properties/a/pattern", "/required"}
    assert Validator({"$ref": "https://json-schema.org/draft/2020-12/schema"}, documents=documents()).ok(True)
    quiet = {"$schema": "x:quiet", "minimum": 5}
    assert Validator(quiet, documents={"x:quiet": {"$vocabulary": {"https://json-schema.org/draft/2020-12/vocab/core": True}}}).ok(1)


def test_reports(spark):
    schema = {"properties": {"a": {"type": "integer", "default": 1, "description": "x|y"}, "b": {"type": "array", "items": {"$ref": "#/$defs/i"}}, "c": {"$ref": "#/$defs/i"}}, "required": ["a"], "$defs": {"i": {"type": "object", "properties": {"d": {"type": ["string", "null"]}, "again": {"$ref": "#/$defs/i"}}}}}
    got = {r.path: (r.type, r.required) for r in property_table(spark, schema).collect()}
    assert got["a"] == ("integer", True) and got["b[].d"] == ("string | null", False) and "c.d" in got
    assert "x\\|y" in markdown(schema)
    assert between_markers("<!-- schema:start -->old<!-- schema:end -->", "new") == "<!-- schema:start -->\nnew\n<!-- schema:end -->"
    with pytest.raises(ValueError):
        between_markers("", "x")
    assert contract_hash({"a": 1, "b": 2}) == contract_hash({"b": 2.0, "a": 1})
    doc = openapi_document("t", "1", [Route("r", "GET", "/a/{id}/{rest+}")])
    assert doc["paths"]["/a/{id}/{rest}"]["get"]["parameters"][1]["name"] == "rest"
    r = spark.range(1).select(*(not_modified(F.lit('"x"'), F.lit(h)).alias(f"c{i}") for i, h in enumerate(('"x"', 'W/"x", "y"', "*", '"z"')))).first()
    assert list(r) == [True, True, True, False]
    body = b'--B\r\nContent-Disposition: form-data; name="f"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\nhi\r\n--B\r\nContent-Disposition: form-data; name="g"\r\n\r\n1\r\n--B--\r\n'
    assert [(p["name"], p["filename"], p["content"]) for p in multipart_parts(body, "B")] == [("f", "a.txt", b"hi"), ("g", None, b"1")]
    df = spark.createDataFrame([(1, bytearray(body), "B"), (2, bytearray(b"--B\r\n"), "B")], "i int, body binary, b string")
    assert [(r.i, r.name, bytes(r.content)) for r in form_parts(df, "body", "b", "i").collect()] == [(1, "f", b"hi"), (1, "g", b"1")]


def test_boundaries_stand_at_the_beginning_of_a_line():
    from tessera.sources.reports import multipart_parts

    body = b'--B\r\nContent-Disposition: form-data; name="a"\r\n\r\nx --B y\r\n--Bz\r\n\r\n--B \r\nContent-Disposition: form-data; name="b"\r\n\r\n\r\n--B--\r\n'
    assert [(p["name"], p["content"]) for p in multipart_parts(body, "B")] == [("a", b"x --B y\r\n--Bz\r\n"), ("b", b"")]


def test_rules_see_absent_fields_and_primitives():
    from tessera.operators.lint import _ABSENT, _fields, detect_formats, load_ruleset, run_rules
    from tessera.operators.openapi import ruleset as openapi_ruleset

    rules = load_ruleset({"extends": [openapi_ruleset()]})
    info = {"title": "T", "version": "1", "contact": {"name": "x"}, "description": "d"}
    for document, code, key in (({"openapi": "3.0.0", "info": info, "paths": {}}, "oas3-api-servers", "servers"), ({"swagger": "2.0", "info": info, "host": "api.test", "paths": {}}, "oas2-api-schemes", "schemes")):
        found = lambda d: {c for c, *_ in run_rules(d, rules, detect_formats(d))}
        assert code in found(document) and code in found({**document, key: []})
        assert code not in found({**document, key: ["https"] if key == "schemes" else [{"url": "https://a.test"}]})
    assert _fields("text", ("a",), "b") == [("text", ("a",), "a")] and _fields({}, ("a",), "b")[0][0] is _ABSENT
