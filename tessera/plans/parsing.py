"""Coercing and strict parsers: loosely typed columns into the types of a schema."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import js_number_from_text, js_number_text
from ..functions.interpreter import Registry
from ..operators.validate import Compiled
from .compiler import Compiler, UnsupportedSchema, View, column
from .defaults import default_of
from .types import struct_type


def literal(x, dtype: T.DataType) -> Column:
    """A JSON value as a column of a type."""
    if x is None:
        return F.lit(None).cast(dtype)
    if isinstance(x, (dict, list)):
        text = F.lit(json.dumps(x))
        return F.parse_json(text) if isinstance(dtype, T.VariantType) else F.from_json(text, dtype)
    if isinstance(dtype, T.VariantType):
        return F.parse_json(F.lit(json.dumps(x)))
    return F.lit(x).cast(dtype)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is written into the plan once however often use refers to it."""
    return F.element_at(F.transform(F.array(c), lambda x: use(x)), 1)


class Parser:
    def __init__(self, cs: Compiled, case_insensitive: bool = False):
        self.cs, self.fold, self.compiler = cs, case_insensitive, cs.compiler()
        self.registry = Registry(cs.schema, cs.documents)

    def column(self, c: Column, dtype: T.DataType, s=None, base: str | None = None, required: bool = True) -> Column:
        """The coerced value: kept if it can be made to fit, else the schema's default; an absent optional one is null."""
        s, base = self.cs.schema if s is None else s, self.registry.root_base if base is None else base
        to = struct_type(s, self.cs.documents) if s is self.cs.schema else self._type(s, base)
        out = self._coerce(c, dtype, s, to, base)
        return out if required else F.when(c.isNotNull(), out)

    def _type(self, s, base: str) -> T.DataType:
        from .types import _type

        return _type(s, self.registry, base, ())

    def _coerce(self, c: Column, d: T.DataType, s, to: T.DataType, base: str) -> Column:
        if not isinstance(s, dict):
            return c
        base = self.registry.base_of.get(id(s), base)
        if isinstance(s.get("$ref"), str):
            target, own = self.registry.resolve(s["$ref"], base)
            return self._coerce(c, d, target, to, own)
        if isinstance(d, T.VariantType):  # taking a member out of JSON is long to write and to compute
            return bound(c, lambda x: self._fitted(x, d, s, to, base))
        return self._fitted(c, d, s, to, base)

    def _fitted(self, c: Column, d: T.DataType, s: dict, to: T.DataType, base: str) -> Column:
        default =literal(default_of(s, self.registry, base), to)
        view = View(c, d)
        if "const" in s:
            return literal(s["const"], to)
        if isinstance(s.get("enum"), list):
            return self._enum(view, s["enum"], to, default)
        kind = s.get("type")
        if isinstance(kind, list):
            return F.coalesce(F.when(column(self.compiler._valid(s, view, base, ())), self._plain(view, to)), default)
        if kind == "string":
            text = F.when(column(view.is_("string")), view.string()).when(column(view.is_("number")), js_number_text(view.number())).when(column(view.is_("boolean")), view.string())
            return self._bounded(text, T.StringType(), s, base, default)
        if kind in ("number", "integer"):
            textual = view.variant or isinstance(d, T.StringType)
            from_text = bound(view.string(), js_number_from_text) if textual else F.lit(None).cast("double")
            n = F.when(column(view.is_("number")), view.number()).when(column(view.is_("boolean")), F.when(view.string() == "true", 1.0).otherwise(0.0)).when(column(view.is_("string")), from_text)

            def finite(n: Column) -> Column:
                n = F.when(~F.isnan(n) & (F.abs(n) < float("inf")) & ((n == F.floor(n)) if kind == "integer" else F.lit(True)), n)
                return self._bounded(n, T.DoubleType(), s, base, default.cast("double"))

            own = bound(n, finite) if textual else finite(n)
            return own.try_cast(to) if kind == "integer" else own
        if kind == "boolean":
            return F.when(c.isNull(), F.lit(False)).when(column(view.is_("boolean")), view.string() == "true").when(column(view.is_("number")), (view.number() != 0) & ~F.isnan(view.number())).when(column(view.is_("string")), view.string() != "").otherwise(~column(view.nullable_null()))
        if kind == "array" and isinstance(to, T.ArrayType):
            arr, e = view.items() if view.is_("array") is not False else (None, None)
            if arr is None:
                return default
            items = s.get("items", {})
            return F.coalesce(F.when(column(view.is_("array")), F.transform(arr, lambda x: self._coerce(x, e, items, to.elementType, base))), default)
        if kind == "object" or "properties" in s:
            return self._object(view, s, to, base)
        return self._plain(view, to)

    def _plain(self, v: View, to: T.DataType) -> Column:
        if v.variant:
            return v.col if isinstance(to, T.VariantType) else F.try_variant_get(v.col, "$", to.simpleString())
        return v.col if v.dtype == to else F.to_variant_object(v.col) if isinstance(to, T.VariantType) and isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)) else v.col.try_cast(to)

    def _bounded(self, c: Column, d: T.DataType, s: dict, base: str, default: Column) -> Column:
        rest = {k: v for k, v in s.items() if k != "type"}
        return F.when(c.isNotNull() & column(self.compiler._valid(rest, View(c, d), base, ())), c).otherwise(default)

    def _enum(self, v: View, values: list, to: T.DataType, default: Column) -> Column:
        texts = [x for x in values if isinstance(x, str)]
        own = F.when(column(self.compiler._member(v, values)), self._plain(v, to))
        if self.fold and texts:
            first: dict[str, str] = {}
            for x in texts:
                first.setdefault(x.lower(), x)
            low, folded = F.lower(v.string()), F.lit(None).cast(to)
            for k, x in first.items():
                folded = F.when(low == k, literal(x, to)).otherwise(folded)
            own = F.coalesce(own, F.when(column(v.is_("string")), folded))
        return F.coalesce(own, default)

    def _object(self, v: View, s: dict, to: T.DataType, base: str) -> Column:
        if isinstance(to, T.MapType):
            m, d = v.entries()
            extra = s.get("additionalProperties") if isinstance(s.get("additionalProperties"), dict) else {}
            return F.coalesce(F.when(column(v.is_("object")), F.transform_values(m, lambda _, x: self._coerce(x, d, extra, to.valueType, base))), F.create_map().cast(to))
        if not isinstance(to, T.StructType):
            return self._plain(v, to)
        if v.variant:
            return bound(v.entries()[0], lambda m: self._members(View(m, T.MapType(T.StringType(), T.VariantType())), s, to, base))
        return self._members(v, s, to, base)

    def _members(self, v: View, s: dict, to: T.StructType, base: str) -> Column:
        """The struct of the declared members; _extra, where the type has it, holds the others."""
        need, fields = set(s.get("required") or []), []
        for f in to.fields:
            if f.name == "_extra":
                known = [g.name for g in to.fields if g.name != "_extra"]
                others = F.lit(None) if v.struct else F.transform_values(F.map_filter(v.entries()[0], lambda k, _: ~k.isin(known)), lambda _, x: x.cast("variant"))
                fields.append(others.cast(f.dataType).alias("_extra"))
                continue
            sub = s["properties"].get(f.name, {}) if "properties" in s else {}
            m = v.member(f.name)
            if m is None:
                own = literal(default_of(sub, self.registry, base), f.dataType) if f.name in need else F.lit(None).cast(f.dataType)
            else:
                got = self._coerce(m.col, m.dtype, sub, f.dataType, base)
                own = got if f.name in need else F.when(m.present, got)
            fields.append(own.alias(f.name))
        return F.struct(*fields)


def parse(df: DataFrame, cs: Compiled, column_name: str | None = None, strict: bool = False, strip_unknown: bool = False, case_insensitive: bool = False, to: str = "parsed") -> DataFrame:
    """df with its columns, or one column, coerced to the schema.

    Without column_name the row is the object: declared columns are replaced by their coerced values; other columns
    stay unless strip_unknown or additionalProperties is false. With it, the value goes to column `to`; a text column
    is read as JSON. With strict nothing is coerced: values stay, and `_errors` says what does not fit.
    """
    if strict:
        from ..operators.validate import validate

        return validate(df, cs, column_name)
    own = Parser(cs, case_insensitive)
    if column_name is not None:
        d = df.schema[column_name].dataType
        c = F.try_parse_json(column_name) if isinstance(d, T.StringType) else F.col(column_name)
        return df.withColumn(to, own.column(c, T.VariantType() if isinstance(d, T.StringType) else d))
    if not isinstance(cs.schema, dict) or "properties" not in cs.schema:
        raise UnsupportedSchema("a row is parsed by a schema with properties")
    d = struct_type(cs.schema, cs.documents)
    row = own._object(View(F.struct(*(F.col(f"`{n}`") for n in df.columns)), df.schema), cs.schema, d, own.registry.root_base)
    parsed = df.withColumn("__tessera_row", row)
    declared = [f.name for f in d.fields if f.name != "_extra"]
    keep = [] if strip_unknown or cs.schema.get("additionalProperties") is False else [n for n in df.columns if n not in declared]
    return parsed.select(*keep, *(F.col("__tessera_row").getField(n).alias(n) for n in declared))


def unknown_keys(df: DataFrame, cs: Compiled, column_name: str) -> Column:
    """The members of a JSON text or VARIANT column that the schema does not declare."""
    c = F.try_parse_json(column_name) if isinstance(df.schema[column_name].dataType, T.StringType) else F.col(column_name)
    keys = F.map_keys(F.try_variant_get(c, "$", "map<string,variant>"))
    return F.coalesce(F.array_except(keys, F.array(*map(F.lit, cs.schema.get("properties", {})))), F.array().cast("array<string>"))


def extended(schema: dict, extensions: dict[str, dict]) -> dict:
    """A schema with optional properties added to its definitions; the name "" stands for the root."""
    out = json.loads(json.dumps(schema))
    for name, props in extensions.items():
        at = out if name == "" else (out.get("$defs") or out.get("definitions") or {}).get(name)
        if at is None:
            raise ValueError(f"no definition {name}")
        at.setdefault("properties", {}).update({k: v for k, v in props.items() if k not in at.get("properties", {})})
    return out


__all__ = ["Compiler", "Parser", "extended", "literal", "parse", "unknown_keys"]
