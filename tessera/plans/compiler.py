"""Schemas compiled to Catalyst: one boolean column, and one column of {message, path} errors.

Works on typed columns (scalars, arrays, structs, maps with string keys) and on VARIANT. Schema work is done on the
driver; the columns hold built-in functions alone. Every predicate is total: a keyword that does not bind a value's
type is true, and a NULL column is an absent value (or a JSON null, with null_means="null"). A schema that cannot be
compiled exactly raises UnsupportedSchema, and the interpreter takes it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import FORMATS, UnsupportedPattern, format_pattern, java_pattern, js_number, js_number_text, js_regex, risky
from ..functions.interpreter import Registry, SchemaError, shown

ERROR = T.StructType([T.StructField("message", T.StringType()), T.StructField("path", T.StringType())])
Truth = bool | Column
_KINDS = ("null", "boolean", "integer", "number", "string", "array", "object")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class UnsupportedSchema(ValueError):
    """A keyword, or a combination with a column's type, that has no exact expression."""


def all_of(*xs: Truth) -> Truth:
    rest = [x for x in xs if x is not True]
    if any(x is False for x in rest):
        return False
    out: Truth = True
    for x in rest:
        out = x if out is True else out & x
    return out


def any_of(*xs: Truth) -> Truth:
    return negated(all_of(*map(negated, xs)))


def negated(x: Truth) -> Truth:
    return not x if isinstance(x, bool) else ~x


def column(x: Truth) -> Column:
    return F.lit(x) if isinstance(x, bool) else x


def escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


class View:
    """A value: its column, its Spark type, and whether it may be missing or null."""

    def __init__(self, col: Column, dtype: T.DataType, null_means: str = "absent"):
        self.col, self.dtype, self.null_means = col, dtype, null_means
        self.variant = isinstance(dtype, T.VariantType)
        self._kind = F.schema_of_variant(col) if self.variant else None

    @property
    def present(self) -> Column:
        return self.col.isNotNull()

    def nullable_null(self) -> Truth:
        """Whether the value is a JSON null."""
        if self.variant:
            return F.coalesce(F.is_variant_null(self.col), F.lit(False))
        return self.col.isNull() if self.null_means == "null" else False

    def is_(self, kind: str) -> Truth:
        if kind not in _KINDS:
            raise SchemaError(f"unknown type {kind!r}")
        if kind == "null":
            return self.nullable_null()
        d, here = self.dtype, negated(self.nullable_null())
        if self.variant:
            t = F.coalesce(self._kind, F.lit("VOID"))
            if kind == "integer":
                x = self.number()
                return (t == "BIGINT") | (t.rlike("^(DECIMAL|DOUBLE|FLOAT)") & F.coalesce(x == F.floor(x.cast("double")), F.lit(False)))
            name = {"boolean": "^BOOLEAN$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING$", "array": "^ARRAY", "object": "^OBJECT"}[kind]
            return t.rlike(name)
        if isinstance(d, _INTEGRAL):
            return here if kind in ("integer", "number") else False
        if isinstance(d, T.DecimalType):
            return here if kind == "number" or d.scale == 0 and kind == "integer" else all_of(here, F.coalesce(self.col == F.floor(self.col), F.lit(True))) if kind == "integer" else False
        if isinstance(d, (T.DoubleType, T.FloatType)):
            if kind == "integer":
                x = self.col.cast("double")
                return all_of(here, F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")) & (x == F.floor(x)), F.lit(True)))
            return here if kind == "number" else False
        families = {"string": (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType), "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}
        return here if kind in families and isinstance(d, families[kind]) else False

    def number(self) -> Column:
        return F.try_variant_get(self.col, "$", "double") if self.variant else self.col.cast("double")

    def string(self) -> Column:
        return F.try_variant_get(self.col, "$", "string") if self.variant else self.col.cast("string")

    def items(self) -> tuple[Column, T.DataType]:
        if self.variant:
            return F.try_variant_get(self.col, "$", "array<variant>"), T.VariantType()
        return self.col, self.dtype.elementType

    def entries(self) -> tuple[Column, T.DataType]:
        """A map of the members; a struct has none."""
        if self.variant:
            return F.try_variant_get(self.col, "$", "map<string,variant>"), T.VariantType()
        return self.col, self.dtype.valueType

    @property
    def struct(self) -> bool:
        return isinstance(self.dtype, T.StructType)

    def member(self, key: str) -> View | None:
        """The view of a member; None if a struct has no such field."""
        if self.struct:
            own = {f.name: f.dataType for f in self.dtype.fields}
            return View(self.col.getField(key), own[key], self.null_means) if key in own else None
        m, d = self.entries()
        return View(F.try_element_at(m, F.lit(key)), d)


class Compiler:
    def __init__(self, schema, formats=(), documents: dict | None = None, null_means: str = "absent", most_nested: int = 64):
        self.schema, self.documents, self.null_means, self.most = schema, documents, null_means, most_nested
        self.formats = tuple(FORMATS) if formats == "all" else tuple(formats)
        self.all_formats = formats == "all"
        self.registry = Registry(schema, documents)

    # ------------------------------------------------------------ entry points

    def valid(self, col: Column, dtype: T.DataType) -> Column:
        """The verdict, never null."""
        v = View(col, dtype, self.null_means)
        ok = self._valid(self.schema, v, self.registry.root_base, ())
        return column(ok if self.null_means == "null" else any_of(ok, v.col.isNull()))

    def errors(self, col: Column, dtype: T.DataType, path: str = "") -> Column:
        """array<struct<message,path>>, in the order of keywords; empty if valid."""
        v = View(col, dtype, self.null_means)
        parts = self._errors(self.schema, v, F.lit(path), self.registry.root_base, ())
        out = self._joined(parts)
        return out if self.null_means == "null" else F.when(v.present, out).otherwise(_none())

    # ------------------------------------------------------------ keyword by keyword

    def _checks(self, s: dict, v: View, base: str, stack: tuple):
        """Yields ("own", ok, message), ("sub", schema, view, key, guard), ("each", ...) in the order of keywords."""
        for ref in ("$ref", "$dynamicRef", "$recursiveRef"):
            if isinstance(s.get(ref), str):
                if ref != "$ref":
                    raise UnsupportedSchema(f"{ref} depends on the scope at run time")
                target, own = self.registry.resolve(s[ref], base)
                if (id(target), id(v.dtype)) in stack or len(stack) >= self.most:
                    raise UnsupportedSchema("a reference leads back to itself")
                yield "same", target, own, (*stack, (id(target), id(v.dtype)))
        if "const" in s:
            c = s["const"]
            yield "own", self._equal(v, c), "must be equal to the expected constant" if isinstance(c, (dict, list)) else f"must be equal to {shown(c)}"
        if isinstance(s.get("enum"), list):
            yield "own", self._member(v, s["enum"]), "must be one of: " + ", ".join(map(shown, s["enum"]))
        if "type" in s:
            kinds = s["type"]
            if isinstance(kinds, list):
                yield "own", any_of(*map(v.is_, kinds)), "must be one of type: " + ", ".join(kinds)
            else:
                yield "own", v.is_(kinds), f"must be {kinds}"
        yield from self._strings(s, v)
        yield from self._numbers(s, v)
        if any(k in s for k in ("minItems", "maxItems", "prefixItems", "items", "uniqueItems", "contains", "unevaluatedItems", "additionalItems")):
            yield from self._arrays(s, v, base, stack)
        if any(k in s for k in ("properties", "required", "dependentRequired", "dependentSchemas", "dependencies", "patternProperties", "additionalProperties", "minProperties", "maxProperties", "propertyNames", "unevaluatedProperties")):
            yield from self._objects(s, v, base, stack)
        for sub in s.get("allOf") or []:
            yield "same", sub, base, stack
        test = lambda sub: self._valid(sub, v, base, stack)
        if s.get("anyOf"):
            yield "own", any_of(*map(test, s["anyOf"])), "must match a schema in anyOf"
        if isinstance(s.get("oneOf"), list):
            hits = [column(test(x)).cast("int") for x in s["oneOf"]]
            yield "own", sum(hits[1:], hits[0]) == 1 if hits else False, "must match exactly one schema in oneOf"
        if "not" in s:
            yield "own", negated(test(s["not"])), "must not match schema"
        if "if" in s:
            hit = test(s["if"])
            for branch, guard in (("then", hit), ("else", negated(hit))):
                if branch in s:
                    yield "when", s[branch], guard
        if "unevaluatedProperties" in s:
            yield from self._unevaluated(s, v, base, stack)
        if "unevaluatedItems" in s:
            raise UnsupportedSchema("unevaluatedItems")

    def _strings(self, s: dict, v: View):
        here = v.is_("string")
        if here is False:
            return
        text = v.string()
        timed = isinstance(v.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
        bind = lambda ok: any_of(negated(here), F.coalesce(ok, F.lit(True)))
        if "minLength" in s:
            yield "own", bind(F.char_length(text) >= s["minLength"]), f"must have at least {js_number(s['minLength'])} characters"
        if "maxLength" in s:
            yield "own", bind(F.char_length(text) <= s["maxLength"]), f"must have at most {js_number(s['maxLength'])} characters"
        if isinstance(s.get("pattern"), str):
            yield "own", bind(text.rlike(self.pattern(s["pattern"]))), f"must match pattern {s['pattern']}"
        f = s.get("format")
        if isinstance(f, str) and (self.all_formats or f in self.formats) and not (timed and f in ("date-time", "date")):
            if f == "regex":
                raise UnsupportedSchema("format regex")
            if p := format_pattern(f):
                yield "own", bind(text.rlike(p)), f'must match format "{f}"'

    def pattern(self, p: str) -> str:
        try:
            if risky(p):
                raise UnsupportedSchema(f"pattern {p} may take exponential time")
            return java_pattern(p)
        except UnsupportedPattern as e:
            raise UnsupportedSchema(str(e)) from e

    def _numbers(self, s: dict, v: View):
        here = v.is_("number")
        if here is False:
            return
        x = v.number()
        bind = lambda ok: any_of(negated(here), F.coalesce(ok & ~F.isnan(x), F.lit(True)))
        low, high = ("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")
        for (k, strict), op, cmp in ((low, ">", (Column.__ge__, Column.__gt__)), (high, "<", (Column.__le__, Column.__lt__))):
            if k in s:
                hard = s.get(strict) is True
                yield "own", bind(cmp[hard](x, F.lit(float(s[k])))), f"must be {op}{'' if hard else '='} {js_number(s[k])}"
        for k, op, cmp in (("exclusiveMinimum", ">", Column.__gt__), ("exclusiveMaximum", "<", Column.__lt__)):
            if k in s and not isinstance(s[k], bool):
                yield "own", bind(cmp(x, F.lit(float(s[k])))), f"must be {op} {js_number(s[k])}"
        if "multipleOf" in s and s["multipleOf"] > 0:
            m = float(s["multipleOf"])
            if m.is_integer():
                ok = F.coalesce(F.try_mod(x, F.lit(m)) == 0, F.lit(False)) & (F.abs(x) < float("inf"))
            else:
                q = x / F.lit(m)
                ok = (F.abs(q) < float("inf")) & (F.abs(q - F.rint(q)) <= 2 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(q)))
            yield "own", any_of(negated(here), F.coalesce(ok & ~F.isnan(x), v.col.isNull())), f"must be a multiple of {js_number(s['multipleOf'])}"

    def _arrays(self, s: dict, v: View, base: str, stack: tuple):
        here = v.is_("array")
        if here is False:
            return
        arr, d = v.items()
        n = F.size(arr)
        bind = lambda ok: any_of(negated(here), F.coalesce(ok, F.lit(True)))
        if "minItems" in s:
            yield "own", bind(n >= s["minItems"]), f"must have at least {js_number(s['minItems'])} items"
        if "maxItems" in s:
            yield "own", bind(n <= s["maxItems"]), f"must have at most {js_number(s['maxItems'])} items"
        prefix = s["prefixItems"] if isinstance(s.get("prefixItems"), list) else s["items"] if isinstance(s.get("items"), list) else []
        rest = s.get("additionalItems") if isinstance(s.get("items"), list) and "prefixItems" not in s else s.get("items")
        for i, sub in enumerate(prefix):
            yield "sub", sub, View(F.try_element_at(arr, F.lit(i + 1)), d, "null"), F.lit(str(i)), F.coalesce(n > i, F.lit(False))
        if rest is False:
            yield "own", bind(n <= len(prefix)), f"must NOT have more than {len(prefix)} items"
        elif rest is not None and rest is not True and not isinstance(rest, list):
            yield "items", rest, arr, d, len(prefix), here
        if s.get("uniqueItems") is True:
            yield "own", bind(F.size(F.array_distinct(F.transform(arr, lambda x: self._key(x, d)))) == n), "must have unique items"
        if "contains" in s:
            hit = lambda x: column(self._valid(s["contains"], View(x, d, "null"), base, stack))
            found, least = F.size(F.filter(arr, hit)), s.get("minContains", 1)
            yield "own", bind(found >= least), f"must contain at least {js_number(least)} matching items"
            if "maxContains" in s:
                yield "own", bind(found <= s["maxContains"]), f"must contain at most {js_number(s['maxContains'])} matching items"

    def _objects(self, s: dict, v: View, base: str, stack: tuple):
        here = v.is_("object")
        if here is False:
            return
        declared = s.get("properties") if isinstance(s.get("properties"), dict) else {}
        required = s["required"] if isinstance(s.get("required"), list) else []
        bind = lambda ok: any_of(negated(here), v.col.isNull(), ok)
        has = lambda k: False if (m := v.member(k)) is None else m.present
        for k, sub in declared.items():
            m = v.member(k)
            if m is not None:
                yield "sub", sub, m, F.lit(k), all_of(here, m.present)
            if k in required:
                yield "own", bind(has(k)), f"must have required property '{k}'"
        for k in required:
            if k not in declared:
                yield "own", bind(has(k)), f"must have required property '{k}'"
        needs = [(t, d) for t, ds in (s.get("dependentRequired") or {}).items() for d in ds]
        needs += [(t, d) for t, ds in (s.get("dependencies") or {}).items() if isinstance(ds, list) for d in ds]
        for t, d in needs:
            yield "own", bind(any_of(negated(has(t)), has(d))), f"must have property '{d}' when '{t}' is present"
        for k in ("dependentSchemas", "dependencies"):
            for t, sub in (s.get(k) or {}).items():
                if not isinstance(sub, list):
                    yield "when", sub, all_of(here, has(t))
        patterns, extra = s.get("patternProperties") or {}, s.get("additionalProperties")
        if v.struct:
            for f in v.dtype.fields:
                known = f.name in declared
                for p, sub in patterns.items():
                    if js_regex(p).search(f.name):
                        known = True
                        yield "sub", sub, v.member(f.name), F.lit(f.name), v.member(f.name).present
                if not known and extra is not None:
                    if extra is False:
                        yield "at", negated(v.member(f.name).present), "must NOT have additional properties", F.lit(f.name)
                    else:
                        yield "sub", extra, v.member(f.name), F.lit(f.name), v.member(f.name).present
            count = sum((column(has(f.name)).cast("int") for f in v.dtype.fields), F.lit(0))
        else:
            m, d = v.entries()
            known = lambda k: any_of(k.isin(list(declared)) if declared else False, *(k.rlike(self.pattern(p)) for p in patterns))
            for p, sub in patterns.items():
                yield "members", sub, m, d, (lambda k, p=p: k.rlike(self.pattern(p))), here
            if extra is False:
                yield "keys", m, lambda k: column(known(k)), "must NOT have additional properties", here
            elif extra is not None and extra is not True:
                yield "members", extra, m, d, lambda k: column(negated(known(k))), here
            count = F.size(F.map_keys(m))
        if "minProperties" in s:
            yield "own", bind(F.coalesce(count >= s["minProperties"], F.lit(True))), f"must have at least {js_number(s['minProperties'])} properties"
        if "maxProperties" in s:
            yield "own", bind(F.coalesce(count <= s["maxProperties"], F.lit(True))), f"must have at most {js_number(s['maxProperties'])} properties"
        if "propertyNames" in s:
            name = lambda k: column(self._valid(s["propertyNames"], View(k, T.StringType()), base, stack))
            if v.struct:
                for f in v.dtype.fields:
                    yield "at", any_of(negated(has(f.name)), name(F.lit(f.name))), f'property name "{f.name}" is invalid', F.lit(f.name)
            else:
                yield "keys", v.entries()[0], name, None, here

    def _unevaluated(self, s: dict, v: View, base: str, stack: tuple):
        """Keys no applicator in place covers: each covers a key, or not, under a condition of the whole value."""
        here = v.is_("object")
        if here is False:
            return
        if v.struct:
            raise UnsupportedSchema("unevaluatedProperties on a struct")
        own = {k: x for k, x in s.items() if k != "unevaluatedProperties"}
        m, d = v.entries()
        cover = lambda k: self._covers(own, k, v, base, stack, 0)
        sub = s["unevaluatedProperties"]
        if sub is False:
            yield "keys", m, lambda k: column(cover(k)), "must NOT have unevaluated properties", here
        elif sub is not True:
            yield "members", sub, m, d, lambda k: column(negated(cover(k))), here

    def _covers(self, s, k: Column, v: View, base: str, stack: tuple, deep: int) -> Truth:
        if deep > 8:
            raise UnsupportedSchema("unevaluatedProperties over more than eight applicators")
        if not isinstance(s, dict):
            return False
        if "additionalProperties" in s or "unevaluatedProperties" in s:
            return True
        terms: list[Truth] = [k.isin(list(s["properties"])) if s.get("properties") else False]
        terms += [k.rlike(self.pattern(p)) for p in s.get("patternProperties") or {}]
        inner = lambda x, guard, b=base: terms.append(all_of(guard, self._covers(x, k, v, b, stack, deep + 1)))
        for x in s.get("allOf") or []:
            inner(x, True)
        for kind in ("anyOf", "oneOf"):
            for x in s.get(kind) or []:
                inner(x, self._valid(x, v, base, stack))
        if "if" in s:
            hit = self._valid(s["if"], v, base, stack)
            inner(s["if"], hit)
            inner(s.get("then", {}), hit)
            inner(s.get("else", {}), negated(hit))
        for t, x in (s.get("dependentSchemas") or {}).items():
            inner(x, False if (mm := v.member(t)) is None else mm.present)
        if isinstance(s.get("$ref"), str):
            target, own = self.registry.resolve(s["$ref"], base)
            inner(target, True, own)
        if "$dynamicRef" in s:
            raise UnsupportedSchema("$dynamicRef beside unevaluatedProperties")
        return any_of(*terms)

    # ------------------------------------------------------------ values

    def _literal(self, v: View, c) -> Truth:
        """Whether a scalar equals a constant of JSON."""
        kind = "null" if c is None else "boolean" if isinstance(c, bool) else "number" if isinstance(c, (int, float)) else "string"
        here = v.is_(kind)
        if here is False or kind == "null":
            return here
        if kind == "string":
            same = v.string() == c
        elif kind == "boolean":
            same = (F.try_variant_get(v.col, "$", "boolean") if v.variant else v.col) == c
        else:
            same = v.number() == F.lit(float(c))
        return all_of(here, F.coalesce(same, F.lit(False)))

    def _equal(self, v: View, c) -> Truth:
        if not isinstance(c, (dict, list)):
            return self._literal(v, c)
        if v.is_("array" if isinstance(c, list) else "object") is False:
            return False
        if isinstance(c, list):
            arr, d = v.items()
            return all_of(v.is_("array"), F.coalesce(F.size(arr) == len(c), F.lit(False)), *(self._equal(View(F.try_element_at(arr, F.lit(i + 1)), d, "null"), x) for i, x in enumerate(c)))
        members = [(k, v.member(k)) for k in c]
        if any(m is None for _, m in members):
            return False
        if v.struct:
            count = sum((v.member(f.name).present.cast("int") for f in v.dtype.fields), F.lit(0))
        else:
            count = F.size(F.map_keys(v.entries()[0]))
        return all_of(v.is_("object"), F.coalesce(count == len(c), F.lit(False)), *(all_of(m.present, self._equal(m, c[k])) for k, m in members))

    def _member(self, v: View, values: list) -> Truth:
        texts = [x for x in values if isinstance(x, str)]
        rest = [x for x in values if not isinstance(x, str)]
        own: Truth = False
        here = v.is_("string")
        if texts and here is not False:
            own = all_of(here, F.coalesce(v.string().isin(texts), F.lit(False)))
        return any_of(own, *(self._equal(v, x) for x in rest))

    def _key(self, x: Column, d: T.DataType) -> Column:
        """One text for equal items."""
        if isinstance(d, T.VariantType):
            kind = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
            n = js_number_text(F.try_variant_get(x, "$", "double"))
            return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.concat(F.lit("n"), n)).otherwise(F.concat(F.lit("v"), F.coalesce(F.to_json(x), F.lit("null"))))
        if isinstance(d, (T.DoubleType, T.FloatType)):
            return F.struct((x.cast("double") + F.lit(0.0)).alias("x"))
        return F.struct(x.alias("x"))

    # ------------------------------------------------------------ putting together

    def _valid(self, s, v: View, base: str, stack: tuple) -> Truth:
        if isinstance(s, bool):
            return s
        if not isinstance(s, dict):
            return True
        base = self.registry.base_of.get(id(s), base)
        parts: list[Truth] = []
        for kind, *x in self._checks(s, v, base, stack):
            if kind in ("own", "at"):
                parts.append(x[0])
            elif kind == "same":
                parts.append(self._valid(x[0], v, x[1], x[2]))
            elif kind == "when":
                parts.append(any_of(negated(x[1]), self._valid(x[0], v, base, stack)))
            elif kind == "sub":
                sub, m, _, guard = x
                parts.append(any_of(negated(guard), self._valid(sub, m, base, stack)))
            elif kind == "items":
                sub, arr, d, at, here = x
                each = lambda e, sub=sub, d=d: column(self._valid(sub, View(e, d, "null"), base, stack))
                own = F.slice(arr, F.lit(at + 1), F.greatest(F.size(arr) - at, F.lit(0))) if at else arr
                parts.append(any_of(negated(here), F.coalesce(F.forall(own, _one(each)), F.lit(True))))
            elif kind == "members":
                sub, m, d, picks, here = x
                pairs = F.map_entries(m)
                each = lambda e, sub=sub, d=d, picks=picks: column(any_of(negated(picks(e["key"])), self._valid(sub, View(e["value"], d, "null"), base, stack)))
                parts.append(any_of(negated(here), F.coalesce(F.forall(pairs, _one(each)), F.lit(True))))
            else:  # keys
                m, ok, _, here = x
                parts.append(any_of(negated(here), F.coalesce(F.forall(F.map_keys(m), _one(ok)), F.lit(True))))
        whole = all_of(*parts)
        return any_of(v.nullable_null(), whole) if s.get("nullable") is True else whole

    def _errors(self, s, v: View, path: Column, base: str, stack: tuple) -> list[Column]:
        """Arrays of errors, to be joined."""
        if s is False:
            return [F.array(_error("must not be valid", path))]
        if not isinstance(s, dict):
            return []
        base = self.registry.base_of.get(id(s), base)
        out: list[Column] = []
        for kind, *x in self._checks(s, v, base, stack):
            if kind in ("own", "at"):
                at = path if kind == "own" else F.concat(path, F.lit("/"), escaped(x[2]))
                if x[0] is not True:
                    out.append(F.when(column(x[0]), _none()).otherwise(F.array(_error(x[1], at))))
            elif kind == "same":
                out += self._errors(x[0], v, path, x[1], x[2])
            elif kind == "when":
                out += self._guarded(x[1], self._errors(x[0], v, path, base, stack))
            elif kind == "sub":
                sub, m, key, guard = x
                out += self._guarded(guard, self._errors(sub, m, F.concat(path, F.lit("/"), escaped(key)), base, stack))
            elif kind == "items":
                sub, arr, d, at, here = x

                def each(e, i, sub=sub, d=d, at=at):
                    own = self._joined(self._errors(sub, View(e, d, "null"), F.concat(path, F.lit("/"), i.cast("string")), base, stack))
                    return F.when(i >= at, own).otherwise(_none()) if at else own

                out += self._guarded(here, [F.coalesce(F.flatten(F.transform(arr, _two(each))), _none())])
            elif kind == "members":
                sub, m, d, picks, here = x

                def member(e, sub=sub, d=d, picks=picks):
                    at = F.concat(path, F.lit("/"), escaped(e["key"]))
                    return F.when(column(picks(e["key"])), self._joined(self._errors(sub, View(e["value"], d, "null"), at, base, stack))).otherwise(_none())

                out += self._guarded(here, [F.coalesce(F.flatten(F.transform(F.map_entries(m), _one(member))), _none())])
            else:
                m, ok, message, here = x
                bad = F.filter(F.map_keys(m), _one(lambda k, ok=ok: ~ok(k)))
                text = lambda k, message=message: F.lit(message) if message else F.concat(F.lit('property name "'), k, F.lit('" is invalid'))
                out += self._guarded(here, [F.coalesce(F.transform(bad, _one(lambda k, text=text: F.struct(text(k).alias("message"), F.concat(path, F.lit("/"), escaped(k)).alias("path")))), _none())])
        if s.get("nullable") is True:
            return self._guarded(negated(v.nullable_null()), out)
        return out

    def _guarded(self, guard: Truth, parts: list[Column]) -> list[Column]:
        if guard is True or not parts:
            return parts
        return [] if guard is False else [F.when(F.coalesce(guard, F.lit(False)), self._joined(parts)).otherwise(_none())]

    @staticmethod
    def _joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _none() -> Column:
    return F.array().cast(T.ArrayType(ERROR))


def _error(message: str, path: Column) -> Column:
    return F.struct(F.lit(message).alias("message"), path.alias("path"))


def _one(f: Callable) -> Callable:
    """Spark counts a lambda's arguments; defaults that bind loop variables must not be among them."""
    return lambda x: f(x)


def _two(f: Callable) -> Callable:
    return lambda x, i: f(x, i)


def schema_text(schema) -> str:
    return json.dumps(schema, sort_keys=False)
