"""The 2020-12 dialect, so that schemas can be checked as data and references to it resolve."""

from __future__ import annotations

from ..functions.interpreter import VALIDATION, Validator

BASE = "https://json-schema.org/draft/2020-12/"
_ANY = {"$dynamicRef": "#meta"}
_MAP = {"type": "object", "additionalProperties": _ANY, "default": {}}
_LIST = {"type": "array", "minItems": 1, "items": _ANY}
_COUNT = {"type": "integer", "minimum": 0}
_NAMES = {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "default": []}
_ANCHOR = {"type": "string", "pattern": "^[A-Za-z_][-A-Za-z0-9._]*$"}
_REF = {"type": "string", "format": "uri-reference"}
_TYPES = {"enum": ["array", "boolean", "integer", "null", "number", "object", "string"]}

# The keywords of each vocabulary.
_WORDS = {
    "core": {
        "$id": {**_REF, "pattern": "^[^#]*#?$"}, "$schema": {"type": "string", "format": "uri"}, "$ref": _REF, "$anchor": _ANCHOR, "$dynamicRef": _REF, "$dynamicAnchor": _ANCHOR,
        "$vocabulary": {"type": "object", "propertyNames": {"type": "string", "format": "uri"}, "additionalProperties": {"type": "boolean"}}, "$comment": {"type": "string"}, "$defs": {"type": "object", "additionalProperties": _ANY},
    },
    "applicator": {
        "prefixItems": _LIST, "items": _ANY, "contains": _ANY, "additionalProperties": _ANY, "properties": _MAP, "patternProperties": {**_MAP, "propertyNames": {"format": "regex"}}, "dependentSchemas": _MAP,
        "propertyNames": _ANY, "if": _ANY, "then": _ANY, "else": _ANY, "allOf": _LIST, "anyOf": _LIST, "oneOf": _LIST, "not": _ANY,
    },
    "unevaluated": {"unevaluatedItems": _ANY, "unevaluatedProperties": _ANY},
    "validation": {
        "type": {"anyOf": [_TYPES, {"type": "array", "items": _TYPES, "minItems": 1, "uniqueItems": True}]}, "const": True, "enum": {"type": "array", "items": True}, "multipleOf": {"type": "number", "exclusiveMinimum": 0},
        "maximum": {"type": "number"}, "exclusiveMaximum": {"type": "number"}, "minimum": {"type": "number"}, "exclusiveMinimum": {"type": "number"}, "maxLength": _COUNT, "minLength": _COUNT, "pattern": {"type": "string", "format": "regex"},
        "maxItems": _COUNT, "minItems": _COUNT, "uniqueItems": {"type": "boolean"}, "maxContains": _COUNT, "minContains": _COUNT, "maxProperties": _COUNT, "minProperties": _COUNT, "required": _NAMES,
        "dependentRequired": {"type": "object", "additionalProperties": _NAMES},
    },
    "meta-data": {"title": {"type": "string"}, "description": {"type": "string"}, "default": True, "deprecated": {"type": "boolean"}, "readOnly": {"type": "boolean"}, "writeOnly": {"type": "boolean"}, "examples": {"type": "array", "items": True}},
    "format-annotation": {"format": {"type": "string"}},
    "content": {"contentEncoding": {"type": "string"}, "contentMediaType": {"type": "string"}, "contentSchema": _ANY},
}


def documents() -> dict[str, dict]:
    """The dialect's documents by URI, to be passed as documents= where a schema refers to them."""
    kind = ["object", "boolean"]
    out = {f"{BASE}meta/{name}": {"$id": f"{BASE}meta/{name}", "$dynamicAnchor": "meta", "type": kind, "properties": words} for name, words in _WORDS.items()}
    vocab = {VALIDATION if n == "validation" else f"{BASE}vocab/{n}": True for n in _WORDS}
    out[f"{BASE}schema"] = {"$schema": f"{BASE}schema", "$id": f"{BASE}schema", "$vocabulary": vocab, "$dynamicAnchor": "meta", "allOf": [{"$ref": f"meta/{n}"} for n in _WORDS], "type": kind}
    return out


def schema_errors(schema) -> list[dict[str, str]]:
    """What is wrong with a schema by its own dialect."""
    return Validator({"$ref": f"{BASE}schema"}, ("regex", "uri-reference"), documents()).errors(schema)
