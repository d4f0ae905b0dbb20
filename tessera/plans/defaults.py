"""Default values and examples of schemas."""

from __future__ import annotations

import math

from ..functions.interpreter import Registry, Validator


def default_of(s, registry: Registry | None = None, base: str = "", depth: int = 0):
    """default, else const, else the first enum member, else the first example, else a branch's, else the type's zero."""
    registry = registry or Registry(s)
    if not isinstance(s, dict) or depth > 32:
        return None
    base = registry.base_of.get(id(s), base)
    for k in ("default", "const"):
        if k in s:
            return s[k]
    for k in ("enum", "examples"):
        if isinstance(s.get(k), list) and s[k]:
            return s[k][0]
    if isinstance(s.get("$ref"), str):
        target, own = registry.resolve(s["$ref"], base)
        return default_of(target, registry, own, depth + 1)
    for k in ("oneOf", "anyOf", "allOf"):
        if s.get(k) and "type" not in s:
            return default_of(s[k][0], registry, base, depth + 1)
    kind = s.get("type")
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    if kind == "string":
        return "x" * min(int(s.get("minLength", 0)), 256)
    if kind in ("number", "integer"):
        return number_in(s, kind == "integer")
    if kind == "boolean":
        return False
    if kind == "array":
        n = min(int(s.get("minItems", 0)), 32)
        prefix = s.get("prefixItems") or []
        items = s["items"] if isinstance(s.get("items"), dict) else {}
        return [default_of(prefix[i] if i < len(prefix) else items, registry, base, depth + 1) for i in range(n)]
    if kind == "object" or "properties" in s:
        return {k: default_of((s.get("properties") or {}).get(k, {}), registry, base, depth + 1) for k in s.get("required") or []}
    return None


def number_in(s: dict, whole: bool):
    """0 moved into the bounds and onto multipleOf; 0 if none fits."""
    low = s.get("minimum", -math.inf)
    high = s.get("maximum", math.inf)
    xl, xh = s.get("exclusiveMinimum"), s.get("exclusiveMaximum")
    step = s.get("multipleOf") or (1 if whole else None)
    gap = step or 1
    if isinstance(xl, (int, float)) and not isinstance(xl, bool):
        low = max(low, xl + (gap if whole or step else min(1, (high - xl) / 2)))
    if isinstance(xh, (int, float)) and not isinstance(xh, bool):
        high = min(high, xh - (gap if whole or step else min(1, (xh - low) / 2 if math.isfinite(low) else 1)))
    x = min(max(0, low), high)
    if step:
        x = math.ceil(round(x / step, 9)) * step
        if x > high:
            x = math.floor(round(high / step, 9)) * step
    return int(x) if float(x).is_integer() else x


SAMPLES = {
    "email": "user@example.com", "idn-email": "user@example.com", "date-time": "2024-01-01T00:00:00Z", "date": "2024-01-01", "time": "00:00:00Z",
    "duration": "P1D", "uuid": "00000000-0000-4000-8000-000000000000", "uri": "https://example.com", "iri": "https://example.com",
    "uri-reference": "/path", "iri-reference": "/path", "uri-template": "/{id}", "json-pointer": "/a", "relative-json-pointer": "0",
    "hostname": "example.com", "idn-hostname": "example.com", "ipv4": "192.0.2.1", "ipv6": "2001:db8::1", "regex": "^a$",
}


def example_of(s, documents: dict | None = None):
    """A valid value where one is found: hints first, then values built from the keywords, each tried by the validator."""
    registry = Registry(s, documents)
    own = _example(s, registry, registry.root_base, 0)
    check = Validator(s, "all", documents)
    for x in (*((s.get("examples") or []) if isinstance(s, dict) else []), *([s["default"]] if isinstance(s, dict) and "default" in s else []), own):
        if check.ok(x):
            return x
    return own


def _example(s, r: Registry, base: str, depth: int):
    if s is True or not isinstance(s, dict) or depth > 24:
        return None
    base = r.base_of.get(id(s), base)
    if "const" in s:
        return s["const"]
    if s.get("enum"):
        return s["enum"][0]
    if isinstance(s.get("$ref"), str):
        target, own = r.resolve(s["$ref"], base)
        return _example(target, r, own, depth + 1)
    if s.get("allOf"):
        merged: dict = {k: v for k, v in s.items() if k != "allOf"}
        for x in s["allOf"]:
            if isinstance(x, dict) and "$ref" in x:
                x = r.resolve(x["$ref"], base)[0]
            merged = merge_all(merged, x if isinstance(x, dict) else {})
        return _example(merged, r, base, depth + 1)
    for k in ("oneOf", "anyOf"):
        if s.get(k):
            for x in s[k]:
                got = _example(merge_all({a: b for a, b in s.items() if a != k}, x if isinstance(x, dict) else {}), r, base, depth + 1)
                if Validator(x).ok(got) if not (isinstance(x, dict) and "$ref" in x) else True:
                    return got
    kind = s.get("type") or ("object" if "properties" in s or "required" in s else "array" if "items" in s or "prefixItems" in s else "string" if any(k in s for k in ("minLength", "maxLength", "pattern", "format")) else "number" if any(k in s for k in ("minimum", "maximum", "multipleOf", "exclusiveMinimum", "exclusiveMaximum")) else None)
    if isinstance(kind, list):
        kind = kind[0]
    if kind == "string":
        text = SAMPLES.get(s.get("format", ""), "string")
        if "pattern" in s:
            text = from_pattern(s["pattern"]) or text
        text += "x" * max(0, int(s.get("minLength", 0)) - len(text))
        return text[: int(s["maxLength"])] if "maxLength" in s else text
    if kind in ("number", "integer"):
        return number_in(s, kind == "integer")
    if kind == "boolean":
        return True
    if kind == "array":
        prefix = s.get("prefixItems") or []
        n = max(int(s.get("minItems", 0)), int(s.get("minContains", 1)) if "contains" in s else 0, min(len(prefix), 1 if prefix else 0))
        items = s.get("items")
        out = []
        for i in range(n):
            sub = prefix[i] if i < len(prefix) else s["contains"] if "contains" in s and i >= n - int(s.get("minContains", 1)) else items
            x = _example(sub, r, base, depth + 1)
            if s.get("uniqueItems") and x in out:
                x = f"{x}{i}" if isinstance(x, str) else x + i if isinstance(x, (int, float)) and not isinstance(x, bool) else x
            out.append(x)
        return out
    if kind == "object":
        props = s.get("properties") or {}
        out = {k: _example(v, r, base, depth + 1) for k, v in props.items() if k in (s.get("required") or []) or depth < 2}
        for k in s.get("required") or []:
            out.setdefault(k, _example(s["additionalProperties"], r, base, depth + 1) if isinstance(s.get("additionalProperties"), dict) else None)
        for t, ds in (s.get("dependentRequired") or {}).items():
            if t in out:
                for d in ds:
                    out.setdefault(d, _example(props.get(d, {}), r, base, depth + 1))
        while len(out) < int(s.get("minProperties", 0)):
            out[f"property{len(out) + 1}"] = _example(s["additionalProperties"], r, base, depth + 1) if isinstance(s.get("additionalProperties"), dict) else None
        for k in list(out):
            if len(out) > int(s.get("maxProperties", len(out))) and k not in (s.get("required") or []):
                del out[k]
        return out
    return None


def merge_all(a: dict, b: dict) -> dict:
    """What must hold for both: tighter bounds, both sets of properties, the common types and enum members."""
    out = dict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif k in ("minimum", "minLength", "minItems", "minProperties", "exclusiveMinimum") and not isinstance(v, bool):
            out[k] = max(out[k], v)
        elif k in ("maximum", "maxLength", "maxItems", "maxProperties", "exclusiveMaximum") and not isinstance(v, bool):
            out[k] = min(out[k], v)
        elif k == "required":
            out[k] = list(dict.fromkeys([*out[k], *v]))
        elif k in ("properties", "patternProperties", "$defs"):
            out[k] = {**out[k], **{n: merge_all(out[k][n], x) if n in out[k] and isinstance(out[k][n], dict) and isinstance(x, dict) else x for n, x in v.items()}}
        elif k == "enum":
            out[k] = [x for x in out[k] if x in v]
        elif k == "type":
            mine, theirs = ([x] if isinstance(x, str) else x for x in (out[k], v))
            both = [x for x in mine if x in theirs] or [x for x in theirs if x == "integer" and "number" in mine] or ["integer"] * ("integer" in mine and "number" in theirs)
            out[k] = both[0] if len(both) == 1 else both
        elif k == "multipleOf":
            a1, b1 = out[k], v
            out[k] = a1 * b1 // math.gcd(a1, b1) if isinstance(a1, int) and isinstance(b1, int) else max(a1, b1)
        else:
            out[k] = v
    return out


def from_pattern(pattern: str) -> str | None:
    """A text that matches a simple pattern: literals, classes and counts; None where it is not simple."""
    import re
    import re._parser as sre

    from ..functions.formats import js_regex

    def build(items) -> str:
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, x = arg[0]
                if str(kind) == "NEGATE":
                    taken = {y for k, y in arg[1:] if str(k) == "LITERAL"}
                    out += next(c for c in "xyzab019" if ord(c) not in taken)
                else:
                    out += chr(x if str(kind) == "LITERAL" else x[0]) if str(kind) in ("LITERAL", "RANGE") else "0" if "DIGIT" in str(x) else " " if "SPACE" in str(x) else "a"
            elif name == "ANY":
                out += "x"
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += build(arg[2]) * arg[0]
            elif name == "SUBPATTERN":
                out += build(arg[3])
            elif name == "BRANCH":
                out += build(arg[1][0])
            elif name == "CATEGORY":
                out += "0"
            elif name != "AT":
                raise ValueError(name)
        return out

    try:
        text = build(sre.parse(pattern))
    except (re.error, ValueError, StopIteration):
        return None
    return text if js_regex(pattern).search(text) else None
