"""JSONPath, filters, rules, lint, fixes, references, sources and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import contract as C
from tessera.operators import lint as L
from tessera.operators.jsonpath import PathError, child, find, jsonpath
from tessera.operators.openapi import endpoints, ruleset
from tessera.operators.refs import bundle, cycles, edges_of, fold_nullable, load_documents, reachable, resolve, upgrade_draft07
from tessera.operators.validate import compile_schema
from tessera.plans.filters import Context, FilterError, compile_filter
from tessera.sources.documents import Lines, glob_match, json_nodes, node_table, plain_scalar, problems, sniff
from tessera.streaming.messages import Frames, checked_messages, rate_limited, windowed_counts

DOC = {"a": {"b": [10, 20, {"c": "x"}], "c": None}, "paths": {"/p": {"get": {"id": 1}, "put": {"id": 2}}}, "list": [{"n": 1, "t": "aa"}, {"n": 5, "t": "b"}]}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$", ["$"]), ("$.a.b[0]", ["$['a']['b'][0]"]), ("$['a']['b'][-1]", ["$['a']['b'][2]"]), ("$.a.b[*]", ["$['a']['b'][0]", "$['a']['b'][1]", "$['a']['b'][2]"]),
        ("$.a.b[2,0]", ["$['a']['b'][2]", "$['a']['b'][0]"]), ("$.a.b[::-2]", ["$['a']['b'][2]", "$['a']['b'][0]"]), ("$.a.b[(@.length-1)]", ["$['a']['b'][2]"]), ("$..c", ["$['a']['c']", "$['a']['b'][2]['c']"]),
        ("$..c^", ["$['a']", "$['a']['b'][2]"]), ("$.list[?(@.n > 2)]", ["$['list'][1]"]), ("$.list[?(@.t.length == 2 || @.n === '5')].n", ["$['list'][0]['n']"]), ("$.paths[*][get,put].id", ["$['paths']['/p']['get']['id']", "$['paths']['/p']['put']['id']"]),
        ("$.paths[*][?(@property.match(/^p/i))]", ["$['paths']['/p']['put']"]), ("$.none.x", []), ("$.a.c.d", []),
    ],
)
def test_paths(path, want):
    from tessera.plans.filters import render

    assert [render(p) for p, _ in find(DOC, path)] == want


def test_path_errors_keys_and_frames(spark):
    for bad in ("a.b", "$[", "$..", "$[?(@.a ==)]", "$[(@.x)]"):
        with pytest.raises(PathError):
            find(DOC, bad)
    assert [v for _, v in find(DOC, "$.a.*~")] == ["b", "c"]
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, "nope"), (3, None)], "i int, t string")
    assert [(r.i, r.ord, r.pointer, r.value) for r in jsonpath(df, "t", "$.list[*].t", "i").collect()] == [(1, 0, "/list/0/t", '"aa"'), (1, 1, "/list/1/t", '"b"')]
    assert [r.x for r in df.select(child("t", "$.a.b[2].c").alias("x")).collect()] == ['"x"', None, None]


def test_filters():
    c = Context({"a": 1, "s": "Foo", "l": [1, 2]}, "key", {"p": 1}, "pk", ("x", "key"), {"r": True})
    for text, want in (
        ("@.a == '1'", True), ("@.a === '1'", False), ("@.b === undefined && !@.b", True), ("@.s.toLowerCase() == 'foo'", True), ("@.l.includes(2) && @.l.length > 1", True), ("@property == 'key' && @parent.p == 1 && @parentProperty == 'pk'", True),
        ("@root.r && $.r", True), ("@.b.c == 1", False), ("/^F/.test(@.s)", True), ("@.a > void 0", False), ("-@.a < 0", True), ("@path == \"$['x']['key']\"", True), ("null == undefined", True), ("null === undefined", False), ("@.s.indexOf('o') == 1", True),
    ):
        assert compile_filter(text)(c) is want, text
    for bad in ("@.a.constructor()", "foo", "(", "1 +", "(" * 200 + "1" + ")" * 200):
        with pytest.raises(FilterError):
            compile_filter(bad)


API = {
    "openapi": "3.1.0", "info": {"title": "t", "version": "1"}, "tags": [{"name": "b"}, {"name": "a"}, {"name": "a"}],
    "paths": {"/x/{id}/": {"get": {"operationId": "o", "tags": ["zz"], "responses": {"404": {}}}, "put": {"operationId": "o", "responses": {"200": {}}}}},
    "components": {"schemas": {"U": {"type": "string", "nullable": True, "enum": ["a", "a", 3]}}},
}


def test_lint_finds_places_overrides_and_fixes(spark):
    text = json.dumps(API, indent=1)
    df = spark.createDataFrame([("api.json", text), ("bad.json", '{"a": 1,}'), ("y.yaml", "a: [1\n"), ("n", None)], "source string, text string")
    rules = {"extends": [[ruleset(), "all"]], "overrides": [{"files": ["*.json#/paths"], "rules": {"operation-success-response": "off", "path-params": "hint"}}]}
    got = L.lint(df, rules).collect()
    by = {(r.source, r.code): r for r in got}
    assert by["bad.json", "parser"].start_char == 8 and ("y.yaml", "parser") in by
    assert ("api.json", "operation-success-response") not in by and by["api.json", "path-params"].severity == 3
    assert {"operation-operationId-unique", "openapi-tags-uniqueness", "typed-enum", "oas3_1-no-nullable", "oas3-unused-component", "operation-tag-defined"} <= {c for _, c in by}
    r = by["api.json", "openapi-tags-uniqueness"]
    assert text.splitlines()[r.start_line][r.start_char :].startswith('"a"')
    fixed = L.fix(df.where("source = 'api.json'"), rules).first()
    assert fixed.converged and [t["name"] for t in json.loads(fixed.text)["tags"]] == ["a", "b", "zz"]
    assert L.report(L.lint(df, rules)).where("line like 'bad.json:1:9 error parser%'").count() == 1
    assert L.ruleset_problems({"rules": {"r": {"then": {"function": "nope"}}}}) and not L.ruleset_problems(ruleset())
    assert ("GET", "/x/{id}/", "o") in endpoints(API) and len(ruleset()["rules"]) == 66
    custom = {"rules": {"mine": {"given": "$.info", "severity": "error", "message": "{{property}}: {{error}}", "then": {"function": "shout"}}}}
    own = L.run_rules(API, L.load_ruleset(custom), functions={"shout": lambda v, o, c: [("loud", None)]})
    assert own == [("mine", 0, ("info",), "info: loud")]


def test_sources(spark, tmp_path):
    nodes = {n.path: (n.kind, n.start, n.end) for n in json_nodes('{"a": [1, "x"]}')}
    assert nodes["a", 1] == ("string", 10, 13) and nodes[()] == ("object", 0, 15)
    assert Lines("a\r\nb\rc\n").at(5) == (2, 0)
    assert plain_scalar("0x1f") == 31 and plain_scalar("Yes") == "Yes" and plain_scalar(".5") == 0.5
    df = spark.createDataFrame([("j", '{"a":1}'), ("y", "a: &x {b: 1}\nc: {<<: *x, d: '2'}\n---\n- q"), ("e", "a: [")], "source string, text string")
    got = {(r.source, r.doc_index, r.pointer): (r.kind, r.value) for r in node_table(df).collect()}
    assert got["j", 0, "/a"] == ("number", "1") and got["y", 0, "/c/d"] == ("string", '"2"') and got["y", 1, "/0"] == ("string", '"q"')
    assert [r.source for r in problems(df).collect()] == ["e"]
    globs = spark.createDataFrame([("a/b/x.json",), ("x.yaml",), ("a/x.json",)], "p string")
    pick = lambda g: [r.p for r in globs.where(glob_match(F.col("p"), g)).collect()]
    assert pick("*.json") == ["a/b/x.json", "a/x.json"] and pick("a/*.json") == ["a/x.json"] and pick("**/x.{json,yaml}") == ["a/b/x.json", "x.yaml", "a/x.json"]
    assert [r.k for r in df.select(sniff(F.col("text")).alias("k")).collect()] == ["json", "yaml", "yaml"]


def test_references(spark, tmp_path):
    doc = {"a": {"$ref": "#/d/x", "description": "mine"}, "b": {"$ref": "#/d/x", "minLength": 2}, "c": {"$ref": "#/none"}, "d": {"x": {"type": "string"}, "loop": {"n": {"$ref": "#/d/loop"}}}}
    out, bad, origins = resolve(doc)
    assert out["a"] == {"type": "string", "description": "mine"} and out["b"] == {"minLength": 2, "allOf": [{"type": "string"}]} and len(bad) == 1 and origins["/a"] == "/d/x"
    assert out["d"]["loop"]["n"]["n"] == {"$ref": "#/d/loop"}
    assert cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]) == [["a", "b", "c"], ["e"]]
    assert ("/a", "#/d/x") in edges_of(doc)
    (tmp_path / "one.json").write_text(json.dumps({"p": {"$ref": "two.json#/q"}}))
    (tmp_path / "two.json").write_text(json.dumps({"q": {"$ref": "#/r"}, "r": {"type": "null"}}))
    assert bundle(str(tmp_path / "one.json"))[0]["p"] == {"type": "null"}
    (tmp_path / "out.json").write_text(json.dumps({"p": {"$ref": "../../x.json"}}))
    with pytest.raises(PermissionError):
        load_documents(str(tmp_path / "out.json"))
    assert upgrade_draft07({"definitions": {"a": {"items": [True], "additionalItems": False}}, "$ref": "#/definitions/a"}) == {"$defs": {"a": {"prefixItems": [True], "items": False}}, "$ref": "#/$defs/a"}
    assert fold_nullable({"type": "string", "nullable": True, "enum": ["a"]}) == {"type": ["string", "null"], "enum": ["a", None]}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "`from` string, `to` string")
    assert {r.node for r in reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}


def test_contracts(spark):
    routes = [C.Route("any", "GET", "/{x}"), C.Route("exact", "GET", "/me"), C.Route("rest", "POST", "/f/{p+}")]
    df = spark.createDataFrame([("get", "/me/"), ("GET", "/a%20b"), ("post", "/f/1/2"), ("put", "/me")], "m string, p string")
    got = df.select(C.route_match(F.col("m"), F.col("p"), routes).alias("r"), C.allowed_methods(F.col("p"), routes).alias("a")).collect()
    assert [r.r and (r.r.route, r.r.params) for r in got] == [("exact", {}), ("any", {"x": "a b"}), ("rest", {"p": "1/2"}), None] and got[3].a == ["GET"]
    with pytest.raises(ValueError):
        C.Route("bad", "GET", "/{a+}/b").pattern
    one = spark.range(1)
    f = C.frame(F.lit(2), F.lit(b"hey"))
    r = one.select(C.unframe(F.concat(f, f, F.lit(b"\x01\x00"))).alias("u"), C.sse(F.lit("a\r\nb"), F.lit("x\ny"), retry=F.lit(1.9)).alias("s")).first()
    assert [(u.kind, bytes(u.payload)) for u in r.u] == [(2, b"hey")] * 2 and r.s == "event: xy\nretry: 1\ndata: a\ndata: b\n\n"
    frames = Frames()
    assert frames.feed(b"\x02\x00\x00\x00\x03he") == [] and frames.feed(b"y") == [(2, b"hey")]
    token = "e30." + "eyJleHAiOjE3fQ" + ".sig"
    r = one.select(C.jwt_expiry(F.lit(token)).alias("e"), C.jwt_expiry(F.lit("x")).alias("n"), C.verified_cookie(C.sign_cookie(F.lit("v.1"), "k"), "k").alias("c"), C.verified_cookie(F.lit("v.bad"), "k").alias("d")).first()
    assert r.e == 17.0 and r.n is None and r.c == "v.1" and r.d is None


def test_streams(spark, tmp_path):
    contract = {"a": compile_schema({"required": ["n"], "properties": {"n": {"type": "integer"}}, "additionalProperties": False})}
    raw = [('{"type":"a","n":1}', None), ('{"type":"a"}', "invalid-payload"), ('{"type":"b"}', "unknown-type"), ("[]", "malformed"), ("{", "malformed"), ('{"n":1}', "unknown-type")]
    spark.createDataFrame([(r,) for r, _ in raw], "raw string").write.parquet(str(tmp_path / "in"))
    stream = checked_messages(spark.readStream.schema("raw string").parquet(str(tmp_path / "in")), "raw", contract)
    q = stream.writeStream.format("memory").queryName("tessera_messages").start()
    q.processAllAvailable()
    q.stop()
    assert {r.raw: r.message.reason for r in spark.table("tessera_messages").collect()} == dict(raw)
    events = spark.sql("select * from values ('k', timestamp '2024-01-01 00:00:00'), ('k', timestamp '2024-01-01 00:00:05'), ('k', timestamp '2024-01-01 00:00:09'), ('k', timestamp '2024-01-01 00:00:10'), ('j', timestamp '2024-01-01 00:00:00') as t(key, ts)")
    got = sorted((r.key, r.hit, r.allowed) for r in C.rate_windows(events, "key", "ts", 2, 10).collect())
    assert got == [("j", 1, True), ("k", 1, True), ("k", 1, True), ("k", 2, True), ("k", 3, False)]
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "ev"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = rate_limited(live, "key", "ts", 2, 10).writeStream.format("memory").queryName("tessera_rates").start()
        q.processAllAvailable()
        q.stop()
        assert sorted((r.key, r.hit, r.allowed) for r in spark.table("tessera_rates").collect()) == got
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert windowed_counts(events, "ts", "key").count() == 2


def test_yaml_repeated_keys_and_merged_nodes_count(spark):
    text = "a: 1\nb: &x {c: 1, c: 2}\nd: *x\n---\ne: 1\n'e': 2\n"
    df = spark.createDataFrame([("y", text), ("fine", "a: {k: 1}\nb: {k: 1}\n")], "source string, text string")
    got = [(r.source, r.doc_index, r.message, r.start_line, r.start_char) for r in problems(df, kind="yaml").collect()]
    assert got == [("y", 0, 'Map key "c" is duplicated', 1, 13), ("y", 1, 'Map key "e" is duplicated', 5, 0)]
    found = [(r.source, r.code, r.start_line) for r in L.lint(df, {"rules": {}}).collect()]
    assert found == [("y", "parser", 1), ("y", "parser", 5)]
    merged = "a0: &a0 {k: [x, x, x, x, x, x, x, x, x, x]}\n" + "".join(f"a{i}: &a{i} {{<<: *a{i - 1}, k{i}: [{', '.join(f'*a{i - 1}' for _ in range(9))}]}}\n" for i in range(1, 7))
    bomb = spark.createDataFrame([("bomb", merged)], "source string, text string")
    assert [r.message for r in problems(bomb, kind="yaml").collect()] == ["aliases expand to too many nodes"]


def test_fixers_of_queries_and_examples_lose_no_member():
    from tessera.operators.lint import fix_document, load_ruleset

    doc = {
        "openapi": "3.1.0",
        "paths": {"/x?a=1": {"get": {}}, "/x?b=2": {"put": {}}, "/y?": {}, "/y": {"get": {}}},
        "components": {"schemas": {"A": {"type": "string", "example": "v"}, "B": {"type": "string", "example": 1, "examples": [2]}}},
    }
    rules = {"extends": [[ruleset(), "off"]], "rules": {"path-not-include-query": "warn", "oas3_1-schema-example-deprecated": "warn"}}
    fixed, _, converged = fix_document(doc, load_ruleset(rules))
    assert converged and fixed["paths"] == {"/x": {"get": {}}, "/x?b=2": {"put": {}}, "/y?": {}, "/y": {"get": {}}}
    assert fixed["components"]["schemas"] == {"A": {"type": "string", "examples": ["v"]}, "B": {"type": "string", "example": 1, "examples": [2]}}


def test_rules_see_references_inlined_unless_they_ask_for_the_raw_document(spark):
    from tessera.operators import openapi

    api = {
        "openapi": "3.1.0", "info": {"title": "x", "version": "1"}, "paths": {"/a/{id}": {"get": {"parameters": [{"$ref": "#/components/parameters/p"}], "responses": {"200": {"$ref": "#/components/responses/r"}}}}},
        "components": {"parameters": {"p": {"name": "wrong", "in": "path", "required": True}}, "responses": {"r": {"content": {"x": {"schema": {"$ref": "#/components/schemas/s"}}}}}, "schemas": {"s": {"type": "object", "properties": {"n": {"$ref": "#/components/schemas/s"}}}}},
    }
    df = spark.createDataFrame([("a.json", json.dumps(api, indent=1)), ("none.json", None)], "source string, text string")
    codes = lambda own: {r.code for r in L.lint(df, {"extends": [openapi.ruleset()]}, resolve_refs=own).collect()}
    inlined, raw = codes(True), codes(False)
    assert "path-params" in inlined and "oas3-unused-component" not in inlined | raw
    rule = {"given": "$.paths..parameters[*]", "then": {"function": "pattern", "field": "name", "functionOptions": {"match": "^right$"}}}
    got = L.lint(df, {"rules": {"named": rule, "as-it-is": {**rule, "resolved": False}}}).collect()
    line = json.dumps(api, indent=1).split("\n").index('    "name": "wrong",')
    assert [(r.code, r.path, r.start_line) for r in got] == [("named", "/paths/~1a~1{id}/get/parameters/0/name", line)]
    wide = {"a0": {"x": 1}, **{f"a{i}": {"l": {"$ref": f"#/a{i - 1}"}, "r": {"$ref": f"#/a{i - 1}"}} for i in range(1, 40)}}
    huge = spark.createDataFrame([("w.json", json.dumps(wide))], "source string, text string")
    assert {r.code for r in L.lint(huge, {"rules": {"r": {"given": "$", "then": {"function": "defined", "field": "no"}}}}).collect()} == {"resolver", "r"}
