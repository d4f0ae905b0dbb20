"""Data that fits a schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import UnsupportedSchema
from ..plans.defaults import example_of
from ..plans.types import struct_type
from .validate import Compiled, is_valid


def example(cs: Compiled):
    """One valid value, always the same."""
    return example_of(cs.schema, cs.documents)


def example_row(spark: SparkSession, cs: Compiled) -> DataFrame:
    return spark.createDataFrame([(json.dumps(example(cs)),)], "value string")


def _random(s: dict, d: T.DataType, seed: list[int]) -> Column:
    """A random value of a schema's type; each use of chance has a seed of its own."""

    def u() -> Column:
        seed[0] += 1
        return F.rand(seed[0])

    def between(a: float, b: float) -> Column:
        return F.lit(a) + F.floor(u() * (b - a + 1))

    if "const" in s:
        return F.lit(json.dumps(s["const"])) if isinstance(s["const"], (dict, list)) else F.lit(s["const"]).cast(d)
    if s.get("enum"):
        if any(isinstance(x, (dict, list)) for x in s["enum"]):
            raise UnsupportedSchema("an enum of compound values")
        return F.element_at(F.array(*(F.lit(x).cast(d) for x in s["enum"])), (1 + F.floor(u() * len(s["enum"]))).cast("int"))
    for k in ("oneOf", "anyOf"):
        if s.get(k):
            own = [_random({**{a: b for a, b in s.items() if a != k}, **x}, d, seed) for x in s[k]]
            pick = F.floor(u() * len(own))
            out = own[-1]
            for i, x in enumerate(own[:-1]):
                out = F.when(pick == i, x).otherwise(out)
            return out
    kind = s.get("type", "object" if "properties" in s else None)
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    if kind == "string":
        f = s.get("format")
        if f == "uuid":
            h = F.md5(u().cast("string"))
            return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
        if f in ("date", "date-time"):
            day = F.date_add(F.lit("2000-01-01").cast("date"), F.floor(u() * 10_000).cast("int"))
            return day.cast("string") if f == "date" else F.concat(day.cast("string"), F.lit("T00:00:00Z"))
        if f == "email":
            return F.concat(F.lit("user"), between(0, 99_999).cast("string"), F.lit("@example.com"))
        if f in ("uri", "iri"):
            return F.concat(F.lit("https://example.com/"), between(0, 99_999).cast("string"))
        if f == "ipv4":
            return F.concat_ws(".", *(between(0, 255).cast("string") for _ in range(4)))
        if f or "pattern" in s:
            return F.lit(str(example_of(s)))
        low = int(s.get("minLength", 0))
        high = int(s.get("maxLength", low + 16))
        letters = F.lit("abcdefghijklmnopqrstuvwxyz")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(high, 1))), lambda i: F.substring(letters, (1 + F.pmod(F.xxhash64(i, F.lit(seed[0]), F.col("id")), F.lit(26))).cast("int"), F.lit(1))), "").substr(F.lit(1), between(low, high).cast("int"))
    if kind in ("number", "integer"):
        step = s.get("multipleOf", 1 if kind == "integer" else None)
        low, high = s.get("minimum"), s.get("maximum")
        xl, xh = s.get("exclusiveMinimum"), s.get("exclusiveMaximum")
        gap = step or 1e-6
        low = low if low is not None else xl + gap if isinstance(xl, (int, float)) and not isinstance(xl, bool) else min(0, high if high is not None else 0)
        high = high if high is not None else xh - gap if isinstance(xh, (int, float)) and not isinstance(xh, bool) else low + 1000
        if step:
            a, b = -(-low // step), high // step
            return (between(a, b) * F.lit(float(step))).cast(d) if kind == "number" else (between(a, b) * F.lit(step)).cast("long")
        return F.lit(float(low)) + u() * F.lit(float(high - low))
    if kind == "boolean":
        return u() < 0.5
    if kind == "array" and isinstance(d, T.ArrayType):
        low = int(s.get("minItems", 0))
        high = int(s.get("maxItems", low + 5))
        items = s.get("items") if isinstance(s.get("items"), dict) else {"type": "string"}
        own = F.array(*(_random(items, d.elementType, seed) for _ in range(high)))
        return F.slice(own, F.lit(1), between(low, high).cast("int")) if high else own
    if kind == "object" and isinstance(d, T.StructType):
        need, fields = set(s.get("required") or []), []
        for f in d.fields:
            if f.name == "_extra":
                continue
            x = _random(s["properties"].get(f.name, {}), f.dataType, seed)
            fields.append((x if f.name in need else F.when(u() < 0.5, x)).alias(f.name))
        return F.struct(*fields)
    raise UnsupportedSchema(f"no generator for {json.dumps(s)[:80]}")


def generate(spark: SparkSession, cs: Compiled, n: int, seed: int = 0, most_factor: int = 20) -> DataFrame:
    """n rows (id, value) that are valid; candidates are drawn in order of id and those that fail the guard are left out.

    The same seed gives the same rows. If too few of most_factor * n candidates are valid, it raises ValueError.
    """
    d = struct_type(cs.schema, cs.documents)
    chance = [seed * 100_003 + 1]
    for factor in (1, 2, 5, most_factor):
        own = spark.range(0, n * factor, 1, max(1, n * factor // 500_000)).select("id", _random(cs.schema, d, chance[:]).alias("value"))
        good = own.where(is_valid(own, cs, "value"))
        if good.limit(n).count() == n:
            return good.limit(n)
    raise ValueError(f"fewer than {n} of {n * most_factor} candidates are valid")


__all__ = ["example", "example_row", "generate"]
