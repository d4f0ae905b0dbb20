"""Contracts over rows: routes, queries, content types, messages, event frames, tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import js_number_from_text, js_number_text
from ..plans.compiler import UnsupportedSchema
from .validate import ERRORS, Compiled

# ---------------------------------------------------------------- routes


@dataclass(frozen=True)
class Route:
    """method and path; in a path {name} takes one segment, {name+} at the end takes the rest."""

    name: str
    method: str
    path: str

    @property
    def slots(self) -> list[str]:
        return [m.rstrip("+") for m in re.findall(r"\{([^}]+)\}", self.path)]

    @property
    def pattern(self) -> str:
        out = []
        parts = [p for p in self.path.split("/") if p]
        for i, p in enumerate(parts):
            m = re.fullmatch(r"\{([^}]+)\}", p)
            if m and m[1].endswith("+"):
                if i < len(parts) - 1:
                    raise ValueError(f"{self.path}: a greedy segment comes last")
                out.append("(.+)")
            elif m:
                out.append("([^/]+)")
            elif "{" in p:
                raise ValueError(f"{self.path}: a segment is a name or a {{slot}}")
            else:
                out.append(re.sub(r"([^A-Za-z0-9_-])", r"\\\1", p))
        return r"\A/" + "/".join(out) + r"\z"


def _trimmed(path: Column) -> Column:
    """A path without one trailing slash."""
    return F.when((F.char_length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.char_length(path) - 1)).otherwise(path)


def route_match(method: Column, path: Column, routes: list[Route]) -> Column:
    """struct<route,params>: a route without slots first, else the first in order of declaration that matches; null if none."""
    at, out = _trimmed(path), F.lit(None).cast("struct<route:string,params:map<string,string>>")
    for r in reversed([r for r in routes if r.slots]):
        pairs = [x for i, n in enumerate(r.slots) for x in (F.lit(n), F.try_url_decode(F.regexp_extract(at, r.pattern, i + 1)))]
        out = F.when((F.upper(method) == r.method.upper()) & at.rlike(r.pattern), F.struct(F.lit(r.name).alias("route"), F.create_map(*pairs).alias("params"))).otherwise(out)
    for r in reversed([r for r in routes if not r.slots]):
        own = r.path if r.path == "/" else r.path.rstrip("/")
        out = F.when((F.upper(method) == r.method.upper()) & (at == own), F.struct(F.lit(r.name).alias("route"), F.create_map().cast("map<string,string>").alias("params"))).otherwise(out)
    return out


def allowed_methods(path: Column, routes: list[Route]) -> Column:
    """The methods, sorted, of the routes whose path matches."""
    at = _trimmed(path)
    own = [F.when(at.rlike(r.pattern), F.lit(r.method.upper())) for r in routes]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*own))))


# ---------------------------------------------------------------- queries and coercion


def coercion_plan(schema: dict) -> dict[str, str]:
    """Of each declared key: number, boolean, or an array of one of these or of strings."""
    plan = {}
    for k, s in (schema.get("properties") or {}).items():
        kind = s.get("type") if isinstance(s, dict) else None
        if kind in ("number", "integer"):
            plan[k] = "number"
        elif kind == "boolean":
            plan[k] = "boolean"
        elif kind == "array":
            item = (s.get("items") or {}).get("type") if isinstance(s.get("items"), dict) else None
            plan[k] = f"{'number' if item in ('number', 'integer') else 'boolean' if item == 'boolean' else 'string'}-array"
    return plan


def _once(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")


def coerced_primitive(raw: Column, kind: str) -> Column:
    """The JSON text of a coerced string: only true and false are booleans, only finite numbers are numbers."""
    if kind == "boolean":
        return _once(raw, lambda r: F.when(r.isin("true", "false"), r).otherwise(_quoted(r)))
    number = lambda r: _once(js_number_from_text(r), lambda n: F.when((F.trim(r) != "") & n.isNotNull() & (F.abs(n) < float("inf")), js_number_text(n)).otherwise(_quoted(r)))
    return _once(raw, number)


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of a query string, decoded, in order."""
    raw = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    half = lambda x, n: F.coalesce(F.try_url_decode(F.when(F.instr(x, "=") == 0, x if n == 0 else F.lit("")).otherwise(F.substring_index(x, "=", 1) if n == 0 else F.substring(x, F.instr(x, "=") + 1, F.char_length(x)))), F.lit(""))
    return F.transform(raw, lambda x: F.struct(half(x, 0).alias("k"), half(x, 1).alias("v")))


def query_value(pairs: Column, key: str, kind: str | None = None) -> Column:
    """JSON text of a key's value under a coercion: the last of repeated keys, or all of them for an array; null if absent."""
    own = F.filter(pairs, lambda p: p["k"] == key)
    if kind is not None and kind.endswith("-array"):
        item = kind.split("-")[0]
        each = F.transform(own, lambda p: _quoted(p["v"]) if item == "string" else coerced_primitive(p["v"], item))
        return F.when(F.size(own) > 0, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
    last = F.try_element_at(own, F.lit(-1))["v"]
    return F.when(F.size(own) > 0, _quoted(last) if kind is None else coerced_primitive(last, kind))


def first_failure(slots: list[tuple[str, Column]]) -> Column:
    """The first slot, in order, whose array of errors is not empty: struct<slot,errors>."""
    return F.coalesce(*(F.when(F.size(e) > 0, F.struct(F.lit(n).alias("slot"), e.alias("errors"))) for n, e in slots))


# ---------------------------------------------------------------- content negotiation


def negotiate(accept: Column, offered: list[str]) -> Column:
    """The most preferred of the offered media types; null if none is accepted, the first one without a header."""
    if not offered:
        return F.lit(None).cast("string")
    parts = F.filter(F.transform(F.split(accept, ","), lambda p: F.struct(F.lower(F.trim(F.substring_index(F.trim(p), ";", 1))).alias("t"), _quality(p).alias("q"))), lambda e: e["t"] != "")
    scored = []
    for i, o in enumerate(offered):
        low = o.lower()
        rank = lambda e, low=low: F.when(e["t"] == low, 3).when(e["t"] == "*/*", 1).when(e["t"] == low.split("/")[0] + "/*", 2).otherwise(0)
        score = _bound(rank)
        best = F.array_max(F.transform(parts, score))
        # within one specificity the entry of higher quality stands first, as entries are sorted by quality
        q = F.array_max(F.transform(F.filter(parts, _equals(score, best)), lambda e: e["q"]))
        scored.append(F.struct(F.when(best > 0, q).otherwise(0.0).alias("q"), F.lit(-i).alias("i"), F.lit(o).alias("o")))
    top = F.array_max(F.array(*scored))
    return F.when(accept.isNull() | (F.trim(accept) == ""), F.lit(offered[0])).when(top["q"] > 0, top["o"])


def _bound(f):
    return lambda e: f(e)


def _equals(score, best):
    return lambda e: score(e) == best


def _quality(part: Column) -> Column:
    q = F.filter(F.transform(F.split(part, ";"), lambda s: F.trim(s)), lambda s: s.startswith("q="))
    last = F.substring(F.try_element_at(q, F.lit(-1)), F.lit(3), F.lit(1000))
    n = js_number_from_text(last)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.when(n.isNotNull() & (F.abs(n) < float("inf")), n).otherwise(1.0))


# ---------------------------------------------------------------- event frames


def sse(data: Column | None = None, event: Column | None = None, event_id: Column | None = None, retry: Column | None = None, comment: Column | None = None) -> Column:
    """A server-sent event's text. Line breaks in data and comments make further fields; in names they are dropped."""
    lines = lambda c, head: F.concat(F.array_join(F.transform(F.split(c, r"\r\n|[\r\n]"), lambda x: F.concat(F.lit(head), x)), "\n"), F.lit("\n"))
    flat = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    parts = []
    if comment is not None:
        parts.append(lines(comment, ": "))
    if event is not None:
        parts.append(F.concat(F.lit("event: "), flat(event), F.lit("\n")))
    if event_id is not None:
        parts.append(F.concat(F.lit("id: "), flat(event_id), F.lit("\n")))
    if retry is not None:
        n = retry.cast("double")
        parts.append(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.concat(F.lit("retry: "), n.cast("long").cast("string"), F.lit("\n"))))
    if data is not None:
        parts.append(lines(data, "data: "))
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts), F.lit("\n"))


def frame(kind: Column, payload: Column) -> Column:
    """A binary frame: one byte of kind, the payload's size as 32 bits big-endian, the payload."""
    return F.concat(F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 8, "0")), payload)


def unframe(data: Column, most: int = 1 << 20) -> Column:
    """array<struct<kind,payload>> of whole frames laid end to end; an unfinished tail is left out, a longer frame is an error."""
    size = lambda d: F.conv(F.hex(F.substring(d, 2, 4)), 16, 10).cast("long")
    state = F.struct(data.alias("rest"), F.array().cast("array<struct<kind:int,payload:binary>>").alias("out"))

    def step(acc, _):
        d = acc["rest"]
        n = F.when(F.octet_length(d) >= 5, size(d)).otherwise(F.lit(-1))
        whole = (n >= 0) & (F.octet_length(d) >= n + 5)
        own = F.struct(F.conv(F.hex(F.substring(d, 1, 1)), 16, 10).cast("int").alias("kind"), F.substring(d, F.lit(6), n.cast("int")).alias("payload"))
        checked = F.when(n > most, F.raise_error(F.lit("a frame is too long")).cast("binary")).otherwise(F.substring(d, (n + 6).cast("int"), F.octet_length(d)))
        return F.when(whole | (n > most), F.struct(checked.alias("rest"), F.array_append(acc["out"], own).alias("out"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(data) / 5).cast("int"))), state, step, lambda a: a["out"])


# ---------------------------------------------------------------- messages


def message_reason(raw: Column, contract: dict[str, Compiled], discriminator: str = "type") -> Column:
    """struct<ok,name,reason,errors>: malformed, unknown-type or invalid-payload, in that order; payloads are checked
    without the discriminator."""
    v = F.try_parse_json(raw)
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    tag_v = F.try_element_at(whole, F.lit(discriminator))
    tag = F.when(F.schema_of_variant(tag_v) == "STRING", F.try_variant_get(tag_v, "$", "string"))
    payload = F.to_variant_object(F.map_filter(whole, lambda k, _: k != discriminator))
    none = F.array().cast(ERRORS)
    found = F.lit(None).cast(ERRORS)
    for name, cs in contract.items():
        found = F.when(tag == name, cs.compiler().errors(payload, T.VariantType())).otherwise(found)
    reason = (
        F.when(~is_object, F.lit("malformed"))
        .when(tag.isNull() | ~F.coalesce(tag.isin(list(contract)), F.lit(False)), F.lit("unknown-type"))
        .when(F.size(found) > 0, F.lit("invalid-payload"))
    )
    return F.struct(reason.isNull().alias("ok"), F.when(is_object, tag).alias("name"), reason.alias("reason"), F.coalesce(F.when(reason == "invalid-payload", found), none).alias("errors"))


def ingest_action(reason: Column, policy: str = "close") -> Column:
    """What happens to a bad message: close, ignore or drop; a good one is delivered."""
    if policy not in ("close", "ignore", "drop"):
        raise ValueError("a policy is close, ignore or drop")
    return F.when(reason.isNull(), F.lit("deliver")).otherwise(F.lit(policy))


def jwt_expiry(token: Column) -> Column:
    """The exp claim, unverified; null if the token cannot be read."""
    body = F.split(token, r"\.")
    part = F.translate(F.try_element_at(body, F.lit(2)), "-_", "+/")
    pad = F.rpad(part, F.ceil(F.char_length(part) / 4).cast("int") * 4, F.lit("="))
    ok = (F.size(body) == 3) & pad.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z")
    return F.when(ok, F.get_json_object(F.unbase64(pad).cast("string"), "$.exp").try_cast("double"))


def sign_cookie(value: Column, secret: str) -> Column:
    """value.signature with HMAC-SHA256 in unpadded URL-safe base64, by batches in Python."""

    @F.pandas_udf("string")
    def run(values):
        import base64
        import hashlib
        import hmac

        own = lambda x: base64.urlsafe_b64encode(hmac.new(secret.encode(), x.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
        return values.map(lambda x: None if x is None else f"{x}.{own(x)}")

    return run(value)


def verified_cookie(signed: Column, secret: str) -> Column:
    """The value of a signed cookie, null if the signature is wrong."""
    value = F.substring(signed, F.lit(1), F.char_length(signed) - F.char_length(F.substring_index(signed, ".", -1)) - 1)
    return F.when(sign_cookie(value, secret) == signed, value)


def path_problems(cs: Compiled) -> list[str]:
    """What keeps a contract's schema from being compiled, for the author."""
    try:
        cs.compiler().valid(F.lit(None), T.VariantType())
    except UnsupportedSchema as e:
        return [str(e)]
    return []


# ---------------------------------------------------------------- rate windows


def rate_windows(df: DataFrame, key: str, ts: str, limit: int, window_seconds: int, order: str | None = None) -> DataFrame:
    """df with window_start, hit and allowed: windows of fixed length that a key's first hit opens.

    A hit at or after a window's end opens the next. Hits past the limit still count. Windows of one key follow from
    each other, so a key is worked through in time order; rows stream through sorted partitions with a state of one
    window, and a key is never gathered. Null keys share no window: each row of them is a first hit.
    """
    tie = [order] if order else []
    schema = T.StructType([*df.schema.fields, T.StructField("window_start", T.LongType()), T.StructField("hit", T.LongType()), T.StructField("allowed", T.BooleanType())])
    span, names = window_seconds * 1_000_000, df.columns
    all_names = [*names, "window_start", "hit", "allowed"]
    timed = df.withColumn("__tessera_us", F.unix_micros(F.col(ts).cast("timestamp")))

    def run(batches):
        import pyarrow as pa

        last, opened, n = object(), None, 0
        for b in batches:
            keys, us = b.column(key).to_pylist(), b.column("__tessera_us").to_pylist()
            starts, hits = [], []
            for k, t in zip(keys, us, strict=True):
                if k is None or k != last or opened is None or t is None or t >= opened + span:
                    last, opened, n = k, t, 0
                n += 1
                starts.append(opened)
                hits.append(n)
            own = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int64()), pa.array(hits, pa.int64()), pa.array([h <= limit for h in hits])], all_names)

    return timed.repartition(key).sortWithinPartitions(key, "__tessera_us", *tie).mapInArrow(run, schema)
