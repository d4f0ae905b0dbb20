"""String formats, regular expressions and number texts as JSON Schema tools in JavaScript see them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pattern for each format. They are written so that Java and Python read them alike; \z ends them.
_H16 = "[0-9a-fA-F]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_LS32 = f"(?:{_H16}:{_H16}|{_IPV4})"
_TIME = r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
_DATE = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]+"
_URI = r"[a-zA-Z][a-zA-Z0-9+\-.]*:/?/?\S*"
_URI_REF = r"(?:[a-zA-Z][a-zA-Z0-9+\-.]*:)?/?/?\S*"
_POINTER = r"(?:/(?:[^~/]|~[01])*)*"
_LABEL = r"(?!-)[a-zA-Z0-9-]{1,63}(?<!-)"
_UNI = r"(?!-)[\p{L}\p{N}\p{M}-]{1,63}(?<!-)"
_IPV6 = "|".join(
    [f"(?:{_H16}:){{6}}{_LS32}", f"::(?:{_H16}:){{5}}{_LS32}", f"(?:{_H16})?::(?:{_H16}:){{4}}{_LS32}"]
    + [f"(?:(?:{_H16}:){{0,{n}}}{_H16})?::{tail}" for n, tail in ((1, f"(?:{_H16}:){{3}}{_LS32}"), (2, f"(?:{_H16}:){{2}}{_LS32}"), (3, f"(?:{_H16}:){_LS32}"), (4, _LS32), (5, _H16), (6, ""))]
)
FORMATS: dict[str, str] = {
    "email": _EMAIL,
    "idn-email": _EMAIL,
    "date-time": f"{_DATE}[Tt]{_TIME}",
    "date": _DATE,
    "time": _TIME,
    "duration": r"P(?!\z)(?:[0-9]+W|(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?)",
    "uuid": "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "uri": _URI,
    "iri": _URI,
    "uri-reference": _URI_REF,
    "iri-reference": _URI_REF,
    "uri-template": r"(?:[^\s{}]|\{[^\s{}]*\})*",
    "json-pointer": _POINTER,
    "relative-json-pointer": rf"(?:0|[1-9][0-9]*)(?:#|{_POINTER})",
    "hostname": rf"(?=.{{1,253}}\z){_LABEL}(?:\.{_LABEL})*",
    "idn-hostname": rf"(?=.{{1,253}}\z){_UNI}(?:\.{_UNI})*",
    "ipv4": _IPV4,
    "ipv6": f"(?:{_IPV6})",
}
ALL_FORMATS = (*FORMATS, "regex")


def format_pattern(name: str) -> str | None:
    """The anchored Java pattern of a format; None for one that is only an annotation, or that is no pattern."""
    return rf"\A(?:{FORMATS[name]})\z" if name in FORMATS else None


def format_ok(name: str, value: str) -> bool:
    """The verdict of a format in Python; unknown formats pass."""
    if name == "regex":
        try:
            java_pattern(value)
            js_regex(value)
        except ValueError:
            return False
        return True
    if name not in FORMATS:
        return True
    import regex

    return regex.fullmatch(FORMATS[name].replace(r"\z", r"\Z"), value) is not None


#: Of a class escape, what it means within brackets in JavaScript.
_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": "\\x09-\\x0D\\x20\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"}


class UnsupportedPattern(ValueError):
    """A regular expression that has no exact counterpart."""


def _translate(pattern: str, end: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise UnsupportedPattern("a pattern ends with a backslash")
            n = pattern[i + 1]
            i += 2
            if n in _CLASSES:
                out.append(_CLASSES[n] if in_class else f"[{_CLASSES[n]}]")
            elif n.lower() in _CLASSES:
                if in_class:
                    raise UnsupportedPattern(f"\\{n} within brackets")
                out.append(f"[^{_CLASSES[n.lower()]}]")
            elif n == "u" and (m := re.match(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})", pattern[i:])):
                i += m.end()
                out.append(re.escape(chr(int(m[1] or m[2], 16))) if int(m[1] or m[2], 16) >= 32 else f"\\x{int(m[1] or m[2], 16):02x}")
            elif n == "c" and i < len(pattern):
                out.append(f"\\x{ord(pattern[i]) % 32:02x}")
                i += 1
            elif n in "pP":
                if not (m := re.match(r"\{([A-Za-z_]+)(?:=([A-Za-z_]+))?\}", pattern[i:])):
                    raise UnsupportedPattern("a property escape without a name")
                i += m.end()
                name = {"Letter": "L", "Number": "N", "Mark": "M", "Punctuation": "P", "Symbol": "S"}.get(m[1], m[1])
                out.append(f"\\{n}{{{'Is' + m[2] if m[1] in ('Script', 'sc', 'Script_Extensions', 'scx') else m[2] or name}}}")
            elif n == "/":
                out.append("/")
            elif n == "-":
                out.append("\\-")
            elif n == "k" and (m := re.match(r"<(\w+)>", pattern[i:])):
                i += m.end()
                out.append(f"\\k<{m[1]}>" if end == r"\z" else f"(?P={m[1]})")
            elif n == "b" and in_class:
                out.append("\\x08")
            else:
                out.append("\\" + n)
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&~" or (c == "^" and pattern[i - 1] != "["):
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            if pattern[i : i + 2] == "[]":
                raise UnsupportedPattern("an empty class")
            out.append(c)
        elif c == "$":
            out.append(end)
        elif c == ".":
            out.append("[^\\n\\r\\u2028\\u2029]")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise UnsupportedPattern("a class is not closed")
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """A JavaScript pattern for rlike: `$` is the very end, classes have JavaScript's sets, `[` and `&` are literal."""
    return _translate(pattern, r"\z")


def js_regex(pattern: str, flags: str = ""):
    """A JavaScript pattern compiled in Python; raises ValueError if it is none."""
    import regex

    try:
        own = re.sub(r"\(\?<(?![=!])", "(?P<", _translate(pattern, r"\Z"))
        return regex.compile(own, regex.IGNORECASE if "i" in flags else 0)
    except regex.error as e:
        raise UnsupportedPattern(str(e)) from e


_QUANTIFIED = re.compile(r"\((?:\?:)?(?:[^()\\]|\\.)*(?:[+*]|\{\d+,\})(?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\})")


def risky(pattern: str) -> bool:
    """Whether an unbounded quantifier stands on a group that holds one, or on alternatives that begin alike."""
    if _QUANTIFIED.search(pattern):
        return True
    for m in re.finditer(r"\((?:\?:)?((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*)\)(?:[+*]|\{\d+,\})", pattern):
        heads = [x[:2] if x[:1] == "\\" else x[:1] for x in m[1].split("|")]
        if len(set(heads)) < len(heads) or "." in heads:
            return True
    return False


def js_number(x) -> str:
    """A number's text as JavaScript writes it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x) if abs(x) < 10**21 else js_number(float(x))
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, body = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, e = body.partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    digits, point = (whole + frac).lstrip("0"), len(whole) + int(e or 0)
    point -= len(whole + frac) - len((whole + frac).lstrip("0"))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e1 = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e1 > 0 else '-'}{abs(e1)}"


def js_number_text(c: Column) -> Column:
    """js_number of a double column; null stays null."""
    s = F.abs(c).cast("string")
    mantissa, exponent = F.substring_index(s, "E", 1), F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1).cast("int")).otherwise(0)
    whole, frac = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", "")
    raw = F.concat(whole, frac)
    lead = F.char_length(raw) - F.char_length(F.ltrim(raw, F.lit("0")))
    digits = F.regexp_replace(F.ltrim(raw, F.lit("0")), "0+$", "")
    point = F.char_length(whole) + exponent - lead
    n = F.char_length(digits)
    body = (
        F.when((point >= n) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), F.greatest(point - n, F.lit(0)))))
        .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits))
        .otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string")))
    )
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity")).when(c == 0, "0").when(c < 0, F.concat(F.lit("-"), body)).when(c > 0, body)


def js_number_from_text(c: Column) -> Column:
    """Number(text) of JavaScript, null where that is NaN: blanks are 0, hexadecimal, octal and binary forms count."""
    t = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    hexa = lambda p, base: F.conv(F.regexp_extract(t, p, 1), base, 10).cast("double")
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
        .when(t.rlike(r"\A0[xX][0-9a-fA-F]{1,15}\z"), hexa(r"\A0[xX]([0-9a-fA-F]+)\z", 16))
        .when(t.rlike(r"\A0[oO][0-7]{1,20}\z"), hexa(r"\A0[oO]([0-7]+)\z", 8))
        .when(t.rlike(r"\A0[bB][01]{1,62}\z"), hexa(r"\A0[bB]([01]+)\z", 2))
        .when(t.rlike(r"\A[+]?Infinity\z"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
    )
