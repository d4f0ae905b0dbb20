"""JSON Schema to Spark types, and back."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.interpreter import Registry

#: The keyword that holds type hints (primitive, instanceOf, brand); callers whose schemas use another name set it.
HINTS = "x-type"


def struct_type(schema, documents: dict | None = None) -> T.DataType:
    """The Spark type of a schema's values; VARIANT where values have no one type or the schema is recursive."""
    registry = Registry(schema, documents)
    return _type(schema, registry, registry.root_base, ())


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [f.name for f in a.fields] + [f.name for f in b.fields if f.name not in a.names]
        out = []
        for n in names:
            fs = [x[n] for x in (a, b) if n in x.names]
            out.append(T.StructField(n, _merge(fs[0].dataType, fs[-1].dataType), len(fs) < 2 or any(f.nullable for f in fs), fs[0].metadata))
        return T.StructType(out)
    return T.VariantType()


def _of_value(x) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int) or (isinstance(x, float) and x.is_integer()):
        return T.LongType()
    return T.DoubleType() if isinstance(x, float) else T.StringType() if isinstance(x, str) else T.VariantType()


def _type(s, registry: Registry, base: str, stack: tuple) -> T.DataType:
    if s is False:
        return T.NullType()
    if not isinstance(s, dict):
        return T.VariantType()
    base = registry.base_of.get(id(s), base)
    hint = s.get(HINTS) if isinstance(s.get(HINTS), dict) else {}
    if hint.get("primitive") == "bigint":
        return T.DecimalType(38, 0)
    if hint.get("instanceOf") == "Date":
        return T.TimestampType()
    if isinstance(s.get("$ref"), str):
        target, own = registry.resolve(s["$ref"], base)
        if id(target) in stack:
            return T.VariantType()
        got = _type(target, registry, own, (*stack, id(target)))
        rest = {k: v for k, v in s.items() if k not in ("$ref", "$defs", "definitions", "$id", "$schema")}
        return _merge(got, _type(rest, registry, base, stack)) if any(k in rest for k in ("properties", "allOf", "type")) else got
    if "const" in s:
        return _of_value(s["const"])
    if isinstance(s.get("enum"), list) and s["enum"]:
        out: T.DataType = T.NullType()
        for x in s["enum"]:
            out = _merge(out, _of_value(x))
        return out
    for kind in ("oneOf", "anyOf"):
        if s.get(kind):
            out = T.NullType()
            branches = [_type(x, registry, base, stack) for x in s[kind]]
            for b in branches:
                out = _merge(out, b)
            if isinstance(out, T.StructType):
                always = [n for n in out.names if all(isinstance(b, T.StructType) and n in b.names and not b[n].nullable for b in branches)]
                out = T.StructType([T.StructField(f.name, f.dataType, f.name not in always, f.metadata) for f in out.fields])
            return out
    if s.get("allOf"):
        out = _type({k: v for k, v in s.items() if k != "allOf"}, registry, base, stack) if "properties" in s or "type" in s else T.NullType()
        for x in s["allOf"]:
            out = _merge(out, _type(x, registry, base, stack))
        return out
    kinds = s.get("type")
    if isinstance(kinds, list):
        own = [k for k in kinds if k != "null"]
        if len(own) != 1:
            return T.DoubleType() if set(own) == {"integer", "number"} else T.VariantType() if own else T.NullType()
        kinds = own[0]
    if kinds is None:
        kinds = "object" if any(k in s for k in ("properties", "patternProperties")) or isinstance(s.get("additionalProperties"), dict) else "array" if any(k in s for k in ("items", "prefixItems")) else None
        if kinds is None:
            return _of_value(s["default"]) if "default" in s else T.VariantType()
    simple = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "null": T.NullType()}
    if kinds in simple:
        return simple[kinds]
    if kinds == "array":
        prefix = s.get("prefixItems") if isinstance(s.get("prefixItems"), list) else s["items"] if isinstance(s.get("items"), list) else None
        if prefix is not None:
            if s.get("items") is False or s.get("additionalItems") is False:
                least = s.get("minItems", 0)
                return T.StructType([T.StructField(f"_{i}", _type(x, registry, base, stack), i >= least) for i, x in enumerate(prefix)])
            return T.ArrayType(T.VariantType())
        return T.ArrayType(_type(s.get("items", True), registry, base, stack))
    if kinds == "object":
        if not s.get("properties"):
            extra = s.get("additionalProperties")
            values = list((s.get("patternProperties") or {}).values()) + ([extra] if isinstance(extra, dict) else [])
            out = T.NullType()
            for x in values:
                out = _merge(out, _type(x, registry, base, stack))
            return T.MapType(T.StringType(), out if values else T.VariantType())
        need = set(s.get("required") or [])
        fields = []
        for k, x in s["properties"].items():
            nullable = k not in need or (isinstance(x, dict) and (x.get("nullable") is True or (isinstance(x.get("type"), list) and "null" in x["type"])))
            meta = {}
            if isinstance(x, dict):
                note = "\n".join(str(x[t]) for t in ("title", "description", "$comment") if t in x)
                if note:
                    meta["comment"] = note
                if isinstance(x.get(HINTS), dict) and "brand" in x[HINTS]:
                    meta["brand"] = str(x[HINTS]["brand"])
            fields.append(T.StructField(k, _type(x, registry, base, stack), nullable, meta))
        extra = s.get("additionalProperties", False)
        out = T.StructType(fields)
        for branch in ("if", "then", "else"):
            if isinstance(s.get(branch), dict) and "properties" in s[branch]:
                more = _type({"type": "object", "properties": s[branch]["properties"]}, registry, base, stack)
                out = _merge(out, more)
                out = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name not in need, f.metadata) for f in out.fields])
        if isinstance(extra, dict) or extra is True or s.get("patternProperties"):
            out = T.StructType([*out.fields, T.StructField("_extra", T.MapType(T.StringType(), T.VariantType()), True)])
        return out
    return T.VariantType()


def from_type(d: T.DataType, strict: bool = False) -> tuple[dict, list[str]]:
    """(schema, warnings) of a Spark type; what JSON has no word for becomes {} with a warning, or an error if strict."""
    notes: list[str] = []

    def of(d: T.DataType, at: str) -> dict:
        if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return {"type": "integer"}
        if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
            return {"type": "integer" if isinstance(d, T.DecimalType) and d.scale == 0 else "number"}
        if isinstance(d, T.StringType):
            return {"type": "string"}
        if isinstance(d, T.BooleanType):
            return {"type": "boolean"}
        if isinstance(d, T.NullType):
            return {"type": "null"}
        if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
            return {"type": "string", "format": "date-time"}
        if isinstance(d, T.DateType):
            return {"type": "string", "format": "date"}
        if isinstance(d, T.ArrayType):
            return {"type": "array", "items": of(d.elementType, f"{at}/items")}
        if isinstance(d, T.MapType) and isinstance(d.keyType, T.StringType):
            return {"type": "object", "additionalProperties": of(d.valueType, f"{at}/additionalProperties")}
        if isinstance(d, T.StructType):
            out = {"type": "object", "properties": {f.name: of(f.dataType, f"{at}/properties/{f.name}") for f in d.fields}}
            need = [f.name for f in d.fields if not f.nullable]
            return out | ({"required": need} if need else {})
        if not isinstance(d, T.VariantType):
            if strict:
                raise ValueError(f"{at or '/'}: {d.simpleString()} has no JSON Schema")
            notes.append(f"{at or '/'}: {d.simpleString()} has no JSON Schema")
        return {}

    return of(d, ""), notes
