"""Rule functions as Catalyst expressions: each gives the message of a finding, or null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import java_pattern, js_number

#: What each casing allows; {d} stands for digits.
CASINGS = {
    "flat": ("[a-z][a-z{d}]*", "", ""),
    "camel": ("[a-z][a-z{d}]*(?:[A-Z][a-z{d}]+)*", "[A-Z]?", ""),
    "pascal": ("[A-Z][a-z{d}]*(?:[A-Z][a-z{d}]+)*", "[A-Z]?", ""),
    "kebab": ("[a-z][a-z{d}]*(?:-[a-z{d}]+)*", "", "-"),
    "cobol": ("[A-Z][A-Z{d}]*(?:-[A-Z{d}]+)*", "", "-"),
    "snake": ("[a-z][a-z{d}]*(?:_[a-z{d}]+)*", "", "_"),
    "macro": ("[A-Z][A-Z{d}]*(?:_[A-Z{d}]+)*", "", "_"),
}


def is_truthy(c: Column, dtype: T.DataType) -> Column:
    """JavaScript's truth of a typed value; null is absent and so false."""
    if isinstance(dtype, T.BooleanType):
        own = c
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        own = (c != 0) & ~F.isnan(c)
    elif isinstance(dtype, T.NumericType):
        own = c != 0
    elif isinstance(dtype, T.StringType):
        own = c != ""
    else:
        own = c.isNotNull()
    return F.coalesce(own, F.lit(False))


def truthy(c: Column, dtype: T.DataType, name: str = "value") -> Column:
    return F.when(~is_truthy(c, dtype), F.lit(f'"{name}" must be truthy'))


def falsy(c: Column, dtype: T.DataType, name: str = "value") -> Column:
    return F.when(is_truthy(c, dtype), F.lit(f'"{name}" must be falsy'))


def defined(c: Column, name: str = "value") -> Column:
    return F.when(c.isNull(), F.lit(f'"{name}" must be defined'))


def undefined(c: Column, name: str = "value") -> Column:
    return F.when(c.isNotNull(), F.lit(f'"{name}" must be undefined'))


def _flagged(p: str) -> str:
    m = re.fullmatch(r"/(.*)/([a-z]*)", p, re.S)
    body, flags = (m[1], m[2]) if m else (p, "")
    return ("(?i)" if "i" in flags else "") + java_pattern(body)


def pattern(c: Column, match: str | None = None, not_match: str | None = None) -> Column:
    """`match` must be found in the text, `not_match` must not; /pattern/flags may be given."""
    out = F.lit(None).cast("string")
    if not_match is not None:
        out = F.when(c.rlike(_flagged(not_match)), F.concat(F.lit('"'), c, F.lit(f'" must not match the pattern "{not_match}"')))
    if match is not None:
        out = F.coalesce(F.when(~c.rlike(_flagged(match)), F.concat(F.lit('"'), c, F.lit(f'" must match the pattern "{match}"'))), out)
    return out


def casing_pattern(kind: str, disallow_digits: bool = False, separator: str = "", allow_leading: bool = False) -> str:
    if kind not in CASINGS:
        raise ValueError(f"a casing is one of {', '.join(CASINGS)}")
    body, tail, own = CASINGS[kind]
    base = body.replace("{d}", "" if disallow_digits else "0-9")
    sep = re.escape(separator)
    lead = f"{sep}?" if separator and allow_leading else ""
    again = f"(?:{sep}{base})*" if separator and separator != own else ""
    return rf"\A{lead}{base}{again}{tail}\z"


def casing(c: Column, kind: str, disallow_digits: bool = False, separator: str = "", allow_leading: bool = False) -> Column:
    """Null and empty texts pass; so does a lone separator that may lead."""
    lone = (c == separator) if separator and allow_leading and len(separator) == 1 else F.lit(False)
    return F.when((c != "") & ~lone & ~c.rlike(casing_pattern(kind, disallow_digits, separator, allow_leading)), F.lit(f"The value must be in {kind} case"))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def length(c: Column, dtype: T.DataType, low: float | None = None, high: float | None = None) -> Column:
    """UTF-16 units of a text, items of an array, keys of a map, or a number itself."""
    n = utf16_length(c) if isinstance(dtype, T.StringType) else F.size(c) if isinstance(dtype, (T.ArrayType, T.MapType)) else c
    if isinstance(dtype, T.StructType):
        n = sum((c.getField(f.name).isNotNull().cast("int") for f in dtype.fields), F.lit(0))
    n = F.when(c.isNotNull(), n)
    out = F.lit(None).cast("string")
    if high is not None:
        out = F.when(n > high, F.lit(f"must not be longer than {js_number(high)}"))
    if low is not None:
        out = F.coalesce(F.when(n < low, F.lit(f"must not be shorter than {js_number(low)}")), out)
    return out


def enumeration(c: Column, values: list) -> Column:
    shown = ", ".join(f'"{v}"' if isinstance(v, str) else str(v) for v in values)
    return F.when(~c.isin(values), F.concat(F.lit('"'), c.cast("string"), F.lit(f'" must be equal to one of the allowed values: {shown}')))


def presence(*cs: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cs), F.lit(0))


def at_least_one(names: list[str], *cs: Column) -> Column:
    return F.when(presence(*cs) == 0, F.lit("At least one of " + ", ".join(f'"{n}"' for n in names) + " must be defined"))


def exactly_one(names: list[str], *cs: Column) -> Column:
    n = presence(*cs)
    listed = " and ".join(f'"{x}"' for x in names)
    return F.when(n == 0, F.lit(f"{listed} must not be both undefined")).when(n > 1, F.lit(f"{listed} must not be both defined"))


def at_most_one(names: list[str], *cs: Column) -> Column:
    return F.when(presence(*cs) > 1, F.lit("Only one of " + ", ".join(f'"{n}"' for n in names) + " may be defined"))


def out_of_order(a: Column, b: Column) -> Column:
    """Whether a stands after b: numbers and numeric texts by value, other texts as texts."""
    x, y = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x > y).otherwise(a.cast("string") > b.cast("string")), F.lit(False))


def message(template: str, **fields: Column) -> Column:
    """A template's {{property}}, {{value}}, {{path}}, {{error}} and {{description}} filled in; unknown ones become empty."""
    out, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        out.append(F.lit(template[at : m.start()]))
        out.append(F.coalesce(fields[m[1]].cast("string"), F.lit("")) if m[1] in fields else F.lit(""))
        at = m.end()
    out.append(F.lit(template[at:]))
    return F.concat(*out)


def fnv1a_hex(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units as 8 hexadecimal digits."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    n = F.char_length(units) / 4
    unit = lambda i: F.conv(F.substring(units, (i * 4 - 3).cast("int"), F.lit(4)), 16, 10).cast("long")
    start = F.lit(0x811C9DC5).cast("long")
    step = lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    folded = F.when(n < 1, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, step))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")
