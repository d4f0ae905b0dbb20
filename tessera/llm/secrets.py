"""Secret scans with DataFrame functions alone: patterns, and sliding-window Shannon entropy of candidate strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length is tested, least length.
BASE = (
    ("assign", r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run of fewer is no match anyway
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are maximal runs of the alphabet with a letter and a digit; hot if a window reaches `bits`.

    `short` holds the bits that shorter candidates must reach as a whole, by length, the last for one less than a window.
    """

    kind: str
    run: str
    alphabet: str
    bits: float
    short: tuple[float, ...] = ()


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "[0-9a-fA-F]", DIGITS + "abcdefABCDEF", 3.0),
    CharClass("entropy_mixed", "[A-Za-z0-9+/_=-]", DIGITS + LOWER + LOWER.upper() + "+/_=-", 3.9),
)
WINDOW = 20
#: Scored after CLASSES, on what these leave. Bits are what 99 % of random strings of the alphabet reach, in a window and
#: at lengths from 12; the widest alphabet comes first, so that a span holds the whole string.
RANDOM = (
    CharClass("entropy_alnum", "[A-Za-z0-9]", DIGITS + LOWER + LOWER.upper(), 3.64, (3.02, 3.08, 3.18, 3.27, 3.32, 3.45, 3.5, 3.57)),
    CharClass("entropy_lower", "[a-z0-9]", DIGITS + LOWER, 3.4, (2.75, 2.87, 2.98, 3.05, 3.14, 3.21, 3.28, 3.32)),
    CharClass("entropy_upper", "[A-Z0-9]", DIGITS + LOWER.upper(), 3.4, (2.75, 2.87, 2.98, 3.05, 3.14, 3.21, 3.28, 3.32)),
    CharClass("entropy_hex_random", "[0-9a-fA-F]", DIGITS + "abcdefABCDEF", 2.9, (2.35, 2.44, 2.54, 2.6, 2.65, 2.74, 2.79, 2.83)),
)
#: Candidates that match one of these are no secrets: samples, runs of the alphabet, repeated characters.
ALLOWED = (r"(?i)example|sample|dummy|placeholder", r"(?i)0123456789|abcdefghij|qwertyuiop", r"(.)\1{7}")

_SPAN = "array<struct<start:int,end:int,kind:string,rank:int,body:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def pattern_spans(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has at least `least` characters, as spans in code points.

    The pieces between matches and the matches themselves, laid end to end, give the places of all matches.
    """
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    tested = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    laid = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), tested.alias("g")), lambda a, m: F.struct(F.char_length(a).alias("gap"), m["w"].alias("w"), m["g"].alias("g")))
    empty = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["w"])
        own = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["w"].alias("body"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["g"]) >= least, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(laid, empty, step, lambda acc: acc["out"])).otherwise(_none())


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(body: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any `window` consecutive characters; of fewer characters, that of all.

    Counts per character are kept for the window and changed by one for the character that enters and the one that
    leaves, and with them the sum of n log n, from which the entropy follows.
    """
    w = F.least(F.lit(window), F.char_length(body))
    place = lambda i: F.instr(F.lit(alphabet), F.substring(body, i, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def step(acc, i):
        into, out = place(i), F.when(i > w, place(i - w)).otherwise(F.lit(0))
        gone = F.when(out > 0, F.element_at(acc["counts"], F.greatest(out, F.lit(1)))).otherwise(F.lit(0))
        come = F.element_at(acc["counts"], into) - F.when(into == out, 1).otherwise(0)
        total = acc["sum"] - F.when(out > 0, _weight(gone) - _weight(gone - 1)).otherwise(F.lit(0.0)) + _weight(come + 1) - _weight(come)
        counts = F.transform(acc["counts"], lambda n, j: n + F.when(j + 1 == into, 1).otherwise(0) - F.when(j + 1 == out, 1).otherwise(0))
        bits = F.log2(w.cast("double")) - total / w
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= w, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(body)), start, step, lambda acc: acc["best"])


def entropy_spans(text: Column, c: CharClass, rank: int, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of candidates that are hot and not on the allow list."""
    least = window - len(c.short)
    bits = F.lit(c.bits)

    def hot(x: Column) -> Column:
        body = x["body"]
        n = F.char_length(body)
        need = F.when(n < window, F.element_at(F.array(*map(F.lit, c.short)), F.greatest(n - least + 1, F.lit(1)))).otherwise(bits) if c.short else bits
        ok = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
        for a in allowed:
            ok = ok & ~body.rlike(a)
        return F.when(ok, F.round(window_entropy(body, c.alphabet, window), 9) >= need).otherwise(F.lit(False))

    # lookarounds keep words without a digit from being listed; they stand at the start of a run and change no candidate
    both = f"(?<!{c.run})(?={c.run}*[0-9])(?={c.run}*[A-Za-z])"
    return F.filter(pattern_spans(text, c.kind, rank, f"{both}{c.run}{{{least},}}"), hot)


def blanked(text: Column, spans: str) -> Column:
    """The text with blanks in place of spans sorted by start, which may overlap; offsets stay."""
    parts = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        at, start, end = acc["at"], F.greatest(acc["at"], x["start"]), F.greatest(acc["at"], x["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.substring(text, at + 1, start - at), F.repeat(F.lit(" "), end - start))).alias("out"))

    def end(acc):
        return F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))), "")

    return F.when(F.size(spans) > 0, F.aggregate(F.col(spans), parts, step, end)).otherwise(text)


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES + RANDOM, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with _base and _spans, arrays of (start, end, kind, rank, body) sorted by start, then kind as listed.

    _base holds the pattern kinds. _spans also holds hot candidates of what pattern spans and hot candidates of classes
    listed earlier leave of the text: a run that one of these covers in part is scored in the rest. Null texts count as
    empty and hold none. Offsets are code points, ends exclusive.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("_base", F.array_sort(F.concat(*(pattern_spans(t, k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)))))
    found = found.withColumn("_spans", F.col("_base"))
    for i, c in enumerate(classes):
        found = found.withColumn("_left", blanked(t, "_spans"))
        found = found.withColumn("_own", entropy_spans(F.col("_left"), c, len(BASE) + i, allowed=allowed))
        found = found.withColumn("_spans", F.when(F.size("_own") == 0, F.col("_spans")).otherwise(F.array_sort(F.concat("_spans", "_own")))).drop("_own", "_left")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    return found.withColumns({c: F.array_sort(c, order) for c in ("_base", "_spans")})


def listed(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark."""
    parts = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    def end(acc):
        return F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))), "")

    return F.when(F.size(spans) > 0, F.aggregate(F.col(spans), parts, step, end)).otherwise(text)
