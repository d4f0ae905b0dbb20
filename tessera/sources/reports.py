"""Schemas and contracts as tables and texts."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.interpreter import Registry, canonical
from ..operators.contract import Route


def property_rows(schema, documents: dict | None = None) -> list[tuple[str, str, bool, str, str]]:
    """(path, type, required, default, description) of every declared property, parents before children."""
    registry, out = Registry(schema, documents), []

    def walk(s, at: str, base: str, stack: tuple):
        if not isinstance(s, dict):
            return
        base = registry.base_of.get(id(s), base)
        if isinstance(s.get("$ref"), str):
            target, own = registry.resolve(s["$ref"], base)
            if id(target) not in stack:
                walk(target, at, own, (*stack, id(target)))
            return
        for k, x in (s.get("properties") or {}).items():
            own = x if isinstance(x, dict) else {}
            if "$ref" in own:
                own = {**registry.resolve(own["$ref"], base)[0], **{a: b for a, b in own.items() if a != "$ref"}}
            kind = own.get("type") or ("enum" if "enum" in own else "any")
            out.append((f"{at}{k}", " | ".join(kind) if isinstance(kind, list) else kind, k in (s.get("required") or []), json.dumps(own["default"]) if "default" in own else "", own.get("description", "")))
            walk(x, f"{at}{k}.", base, stack)
        if isinstance(s.get("items"), dict):
            walk(s["items"], f"{at[:-1]}[]." if at else "[].", base, stack)

    walk(schema, "", registry.root_base, ())
    return out


def property_table(spark: SparkSession, schema, documents: dict | None = None) -> DataFrame:
    return spark.createDataFrame(property_rows(schema, documents), "path string, type string, required boolean, default string, description string")


def markdown(schema, documents: dict | None = None) -> str:
    """The property table as Markdown."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    rows = ["| Property | Type | Required | Default | Description |", "|---|---|---|---|---|"]
    return "\n".join(rows + [f"| `{cell(p)}` | {cell(t)} | {'yes' if r else 'no'} | {f'`{cell(d)}`' if d else ''} | {cell(n)} |" for p, t, r, d, n in property_rows(schema, documents)])


def between_markers(text: str, body: str, name: str = "schema") -> str:
    """text with what stands between <!-- name:start --> and <!-- name:end --> replaced; ValueError without markers."""
    pattern = re.compile(rf"(<!-- {re.escape(name)}:start -->).*?(<!-- {re.escape(name)}:end -->)", re.S)
    if not pattern.search(text):
        raise ValueError(f"no markers for {name}")
    return pattern.sub(lambda m: f"{m[1]}\n{body}\n{m[2]}", text)


def contract_hash(contract) -> str:
    """A hash that does not depend on the order of keys."""
    return hashlib.sha256(canonical(contract).encode()).hexdigest()


def not_modified(etag: Column, if_none_match: Column) -> Column:
    """Whether a request's If-None-Match names the tag; weak tags compare alike, * names any."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"\AW/", "")
    return F.coalesce((F.trim(if_none_match) == "*") | F.exists(F.split(if_none_match, ","), lambda x: bare(x) == bare(etag)), F.lit(False))


def openapi_document(title: str, version: str, routes: list[Route], schemas: dict[str, dict] | None = None) -> dict:
    """An OpenAPI document of routes; operation ids are the routes' names."""
    paths: dict[str, dict] = {}
    for r in routes:
        path = re.sub(r"\{([^}+]+)\+\}", r"{\1}", r.path)
        params = [{"name": s, "in": "path", "required": True, "schema": {"type": "string"}} for s in r.slots]
        op = {"operationId": r.name, "responses": {"200": {"description": "OK"}}}
        paths.setdefault(path, {})[r.method.lower()] = {**op, **({"parameters": params} if params else {})}
    out = {"openapi": "3.2.0", "info": {"title": title, "version": version}, "paths": paths}
    return {**out, "components": {"schemas": schemas}} if schemas else out


def multipart_parts(body: bytes, boundary: str, most_parts: int = 1000, most_bytes: int = 10_000_000) -> list[dict]:
    """name, filename, content type and content of each part of a form; an unfinished body or a cap passed is an error."""
    # a boundary stands at the beginning of a line that holds nothing else
    pieces = re.split(rb"(?:\A|\r\n)--" + re.escape(boundary.encode()) + rb"(?=--|[ \t]*\r\n)", body)
    last = next((i for i, p in enumerate(pieces) if i and p.startswith(b"--")), None)
    if last is None:
        raise ValueError("the body is not finished")
    if last - 1 > most_parts or len(body) > most_bytes:
        raise ValueError("too many parts or bytes")
    out = []
    for p in pieces[1:last]:
        head, _, content = p.lstrip(b" \t").removeprefix(b"\r\n").partition(b"\r\n\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
        named = dict(re.findall(r'(\w+)="([^"]*)"', headers.get("content-disposition", "")))
        out.append({"name": named.get("name", ""), "filename": named.get("filename"), "content_type": headers.get("content-type", "text/plain"), "content": content})
    return out


def form_parts(df: DataFrame, body: str, boundary: str, *keys: str) -> DataFrame:
    """(keys, ord, name, filename, content_type, content): a row for each part; bodies that are not finished have none."""
    from pyspark.sql import types as T

    schema = df.select(*keys).schema
    for n, k in (("ord", T.IntegerType()), ("name", T.StringType()), ("filename", T.StringType()), ("content_type", T.StringType()), ("content", T.BinaryType())):
        schema = schema.add(n, k)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for i, (raw, mark) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                try:
                    parts = multipart_parts(raw or b"", mark or "")
                except ValueError:
                    continue
                for n, p in enumerate(parts):
                    at.append(i)
                    rows.append((n, p["name"], p["filename"], p["content_type"], p["content"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary())
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return df.select(*keys, F.col(body).cast("binary"), F.col(boundary).cast("string")).mapInArrow(run, schema)
