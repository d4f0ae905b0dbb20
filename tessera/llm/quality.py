"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"


class Text:
    """A text's measures, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that hold a word."""
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a 5-word window found twice or more, the first one included; compared exactly."""
        n = self.n_words
        if n < 6:
            return 0
        ids: dict[str, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in self.words], dtype=np.int64)
        k = int(len(ids)).bit_length()
        if 5 * k <= 63:
            code = w[:-4] << 4 * k | w[1:-3] << 3 * k | w[2:-2] << 2 * k | w[3:-1] << k | w[4:]
        else:  # number the pairs, then the fours, so that codes stay exact
            two = np.unique(w[:-1] << 31 | w[1:], return_inverse=True)[1]
            four = np.unique(two[:-2] << 31 | two[2:], return_inverse=True)[1]
            code = four[:-1] << 31 | w[4:]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        if not same.any():
            return 0
        again = np.zeros(len(code), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The base rules, which are not part of the cascade's verdict on their own.
BASE = (Rule("few_words", lambda t: t.n_words < 10), Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words))

#: The method's own rules. Ratios are compared in whole numbers, so that SQL decides alike.
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
)


def order_rules(texts: Iterable[str | None], rules: tuple[Rule, ...] = RULES, clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """Rules by estimated rejections per second on a sample, highest first; ties keep the given order.

    Each rule is timed from scratch, so a measure that two rules share counts for both. Rejections are counted with
    one added to both parts, so a rule that rejects nothing in the sample still ranks by its cost.
    """
    sample = list(texts)
    score = {}
    for r in rules:
        hits, began = 0, clock()
        for x in sample:
            hits += r.rejects(Text(x))
        score[r.name] = (hits + 1) / (len(sample) + 2) / max(clock() - began, 1e-9)
    return sorted(rules, key=lambda r: -score[r.name])


def sample_texts(docs: DataFrame, text: str = "text", size: int = 1000) -> list[str | None]:
    """About `size` texts, never more than twice that, chosen by hash all over the table; it only steers the order."""
    n = docs.count()
    share = min(1.0, size / max(n, 1))
    bound = min(2**63 - 1, round((share * 2 - 1) * 2**62) * 2)
    return [r[0] for r in docs.where(F.xxhash64(text, F.lit(17)) <= F.lit(bound)).select(text).limit(2 * size).collect()]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000, measures: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, verdict fields): kept boolean and rejected_by string, the first rule in the chosen order that rejects.

    With measures, also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. The order
    of rules is estimated on a sample and changes only how soon a text is rejected, never whether. Null texts count as
    empty and fail few_words. An empty table gives an empty table.
    """
    ordered = order_rules(sample_texts(docs, text, sample), rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[] for _ in range(len(names) + 3)]
            for x in b.column(1).to_pylist():
                t = Text(x)
                by = next((r.name for r in ordered if r.rejects(t)), None)
                for to, name in zip(out, names, strict=False):
                    to.append(getattr(t, name))
                out[-3].append(any(r.rejects(t) for r in BASE) if measures else None)
                out[-2].append(by is None)
                out[-1].append(by)
            kinds = [pa.int64()] * len(names) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", *names, "base_failed", "kept", "rejected_by"])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_failed boolean, kept boolean, rejected_by string"])
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)
