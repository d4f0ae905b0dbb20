"""Substring dedup by hashing lines, paragraphs or sentences.

Units of all documents are normalised and hashed; digests are grouped globally, the earliest ranked occurrence of each
stays and the others are removed, with their offsets in the original text kept. A passage that begins inside a line
shares no whole line with its other occurrences, so units can also be the sentences of lines; as single sentences
repeat by chance, only runs of adjacent repeated units with `min_run` words or more then count.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lean, stored

#: White space as the corpus contracts define it.
_SPACE = re.compile(r"[\x09-\x0D\x20]+")
#: What ends a unit; a unit's span takes in what ends it.
_CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[\x20\x09]*\n)+"), "sentence": re.compile(r"\n|[.!?][\x20\x09]+|[。！？]")}
#: What a text whose last unit goes loses before it, besides.
_TAILS = {"line": r"\n\z", "paragraph": r"\n\z", "sentence": r"(?:\n|[\x20\x09]+)\z"}
#: White space of str.split() that the corpus contracts count as part of words.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_UNITS = "doc_id long, text_hash binary, k int, start int, end int, words int, digest binary"
#: Characters that count as a word, for scripts without blanks.
WORD_CHARS = 10
#: Production parameters: passages of a few sentences, wherever in a line they begin. Single sentences and lines of
#: licenses and footers that many clean documents have stay.
PASSAGES = {"unit": "sentence", "min_words": 4, "min_run": 30}


def normal(unit: str) -> str:
    """Composed, lower case, one blank between words, none at the ends."""
    if not unit.isascii():
        unit = unicodedata.normalize("NFC", unit)
    return _SPACE.sub(" ", unit.lower()).strip(" ")


def spans(text: str, unit: str, min_words: int):
    """(start, end, words, digest) of the units of at least min_words words; offsets in code points, end exclusive.

    A unit's span takes in the separator behind it, so removing spans leaves the other units as they were. A unit of
    few or no blanks has as many words as it has tens of characters.
    """
    import xxhash

    digest = xxhash.xxh3_128_digest
    plain = (text.isascii() or unicodedata.is_normalized("NFC", text)) and not _ODD.search(text)
    at = 0
    ends = [m.end() for m in _CUTS[unit].finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        if plain:
            words = text[at:end].lower().split()
            own, n = " ".join(words), len(words)
        else:
            own = normal(text[at:end])
            n = own.count(" ") + 1 if own else 0
        n = max(n, len(own) // WORD_CHARS)
        if n and n >= min_words:
            yield at, end, n, digest(own.encode("utf-8", "surrogatepass"))
        at = end


def repeated_spans(docs: DataFrame, unit: str = "line", min_words: int = 4, min_run: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored (doc_id, text_hash, spans array<struct<start,end>>): what later occurrences of units cover.

    The rank of an occurrence is (doc_id with nulls last, hash of the text, start), so rows that repeat a doc_id with
    its text count as one document. Units under min_words words are not hashed. With min_run, later occurrences count
    only in runs: units of one text that follow each other, but for units that are not hashed, and have min_run words
    or more together; a run's span covers all that lies between its ends.

    Digests that occur once fall out by a count with partial sums, and the rest are joined back by a merge join that
    adaptive execution can split where a unit is very common; a digest's first occurrence is a partial minimum.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for b in batches:
            starts, ends, sizes, digests, counts, hashes = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                n = len(starts)
                hashes.append(hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest()[:8])
                for s, e, w, d in spans(t, unit, min_words) if t else ():
                    starts.append(s)
                    ends.append(e)
                    sizes.append(w)
                    digests.append(d)
                counts.append(len(starts) - n)
            of = np.repeat(np.arange(b.num_rows), counts)
            k = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
            take = pa.array(of, pa.int64())
            out = [b.column(0).take(take), pa.array(hashes, pa.binary()).take(take), pa.array(k, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())]
            for at in range(0, len(starts), 200_000):  # a batch of long texts has many units
                yield pa.RecordBatch.from_arrays([c.slice(at, 200_000) for c in out], ["doc_id", "text_hash", "k", "start", "end", "words", "digest"])

    units = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), _UNITS), "units")
    many = stored(units.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "start")
    again = stored(units.join(many.hint("merge"), "digest"), "repeated-units")
    firsts = stored(again.groupBy("digest").agg(F.min(rank).alias("first")), "firsts")
    later = again.join(firsts.hint("merge"), "digest").where(rank != F.col("first"))
    # one exchange by text serves what follows; a text's units are bounded by its length
    place = later.select("doc_id", "text_hash", "k", "start", "end", "words").repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "k"])
    if min_run:
        run_of = F.col("k") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("k"))
        place = place.withColumn("run", run_of).groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words")).where(F.col("words") >= min_run)
    out = stored(place.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    drop(units, many, again, firsts)
    return out


def dedup_substrings(docs: DataFrame, unit: str = "line", min_words: int = 4, min_run: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the later occurrences of repeated units cut out of its text, and _removed array<struct<start,end>>.

    Offsets are code points of the original text. A document whose units are all unique, and one with a null or empty
    text, is returned as it was, with an empty _removed. Units of fewer than min_words words are never removed, but
    within a run; with min_run, nor are runs of adjacent repeated units with fewer words in all. An empty table gives
    an empty table; other columns stay as they are, but for one named _removed, which is replaced, and names that
    begin with __tessera, which are reserved.
    """
    key, digest, own = "__tessera_key", "__tessera_hash", "__tessera_own"
    gone = repeated_spans(docs, unit, min_words, min_run, text, doc_id).select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("spans").alias("_removed"))
    hashed = docs.drop("_removed").withColumn(own, F.substring(F.unhex(F.md5(F.col(text))), 1, 8))
    # a merge join, so that the plan is the same at every size
    both = hashed.join(gone.hint("merge"), (F.col(own) == F.col(digest)) & F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "left")
    removed = F.coalesce("_removed", F.array().cast("array<struct<start:int,end:int>>"))
    # what lies between the removed spans, then what follows the last of them
    n = F.char_length(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["end"]))
    ends = F.concat(F.transform(removed, lambda s: s["start"]), F.array(n))
    rest = F.array_join(F.zip_with(starts, ends, lambda a, z: F.substring(F.col(text), a + 1, F.greatest(z - a, F.lit(0)))), "")
    # a text whose last unit goes loses the separator before it too
    rest = F.when(F.try_element_at(removed, F.lit(-1))["end"] == n, F.regexp_replace(rest, _TAILS[unit], "")).otherwise(rest)
    cut = F.when(F.col("_removed").isNull(), F.col(text)).otherwise(rest)
    return both.withColumns({text: cut, "_removed": removed}).drop(own, key, digest)
