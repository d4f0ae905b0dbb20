"""Byte-level BPE encoding and decoding.

Distinct words are encoded once by Spark higher-order functions: a fold over a word's byte array merges, step by step,
the neighbours of lowest rank, which it looks up in a literal map. A task that splits documents numbers the words of a
block of them and keeps each document as numbers; the block's words are joined with their ids and written as one file
in the order of their numbers, and a task that turns the block's documents into ids reads that file alone. So no task
holds more than one block's words, texts are split once, and documents are never shuffled. Decoding concatenates the
ids' binary pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_system, lean, new_path, stored
from .jaccard import group_starts, groups

#: Slots of the literal map, a power of two. A map's keys are searched one by one, so ranks are dealt to small maps by hash.
SLOTS = 65_536
#: Longer words, in bytes, are merged with a heap instead; the fold copies its arrays at each step.
FOLD_BYTES = 128
#: A block ends when its documents hold so many distinct words, or eight slices of words; a place is a block and a
#: word's number, of PLACES bits.
BLOCK_WORDS, PLACES = 500_000, 24
#: Words that are worked on at once.
SLICE = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank from a rank file; the file's path is the caller's."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """array<map<string,int>>: slot by hash, then rank by bytes, each byte as the character of that number."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for k, v in ranks.items():
        name = k.decode("latin-1")
        slots[xxhash.xxh64_intdigest(name.encode("utf-8"), seed=42) & (SLOTS - 1)][name] = v
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: within a fold, equal expressions are computed again at each place."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def encoded(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of a word of at most FOLD_BYTES bytes.

    The fold's state has one long for each two neighbouring pieces: the rank of their union, then where the first
    begins, where the second begins and where it ends. The least of these is the next merge, leftmost among equals.
    """
    none = F.lit(2**31 - 1)
    no_pairs = F.array().cast("array<bigint>")
    begin, middle, end = (lambda x: F.shiftright(x, 16).bitwiseAND(F.lit(255)), lambda x: F.shiftright(x, 8).bitwiseAND(F.lit(255)), lambda x: x.bitwiseAND(F.lit(255)))

    def under(slots: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.coalesce(F.try_element_at(F.element_at(slots, (F.xxhash64(piece).bitwiseAND(F.lit(SLOTS - 1)) + 1).cast("int")), piece), none)

        def folded(bytes_: Column) -> Column:
            n = F.char_length(bytes_)

            def pair(a: Column, m: Column, z: Column) -> Column:
                known = rank(F.substring(bytes_, (a + 1).cast("int"), (z - a).cast("int"))).cast("long")
                return F.shiftleft(known, 24).bitwiseOR(F.shiftleft(a.cast("long"), 16)).bitwiseOR(F.shiftleft(m.cast("long"), 8)).bitwiseOR(z.cast("long"))

            def joined(pairs: Column, low: Column, at: Column) -> Column:
                a, z = begin(low), end(low)
                before = F.when(at > 1, F.array(pair(begin(F.get(pairs, at - 2)), a, z))).otherwise(no_pairs)
                after = F.when(at < F.size(pairs), F.array(pair(a, z, end(F.get(pairs, at))))).otherwise(no_pairs)
                return F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(pairs, at + 2, F.size(pairs)))

            def merge(pairs: Column, _: Column) -> Column:
                def at_lowest(low: Column) -> Column:
                    found = once(F.array_position(pairs, low).cast("int"), lambda at: joined(pairs, low, at))
                    return F.when(low < F.lit((2**31 - 1) << 24), found).otherwise(pairs)

                # an empty array has no least element
                return once(F.coalesce(F.array_min(pairs), F.lit(2**62)), at_lowest)

            def pieces(pairs: Column) -> Column:
                starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(pairs, middle))
                ends = F.concat(F.transform(pairs, middle), F.array(n.cast("long")))
                return F.zip_with(starts, ends, lambda a, z: rank(F.substring(bytes_, (a + 1).cast("int"), (z - a).cast("int"))))

            first = F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 1, i + 2))
            return once(F.aggregate(F.sequence(F.lit(1), n - 1), first, merge), pieces)

        def whole_or_folded(bytes_: Column) -> Column:
            return once(rank(bytes_), lambda whole: F.when(whole < none, F.array(whole)).otherwise(folded(bytes_)))

        return once(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), whole_or_folded)

    return F.element_at(F.transform(F.array(ranks), under), 1)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: the same merges, kept in a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j >= n or end[j] != e or end[i] != j:
            continue
        end[i], nxt[i] = e, nxt[j]
        dead[j] = 1
        if nxt[j] < n:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] < n:
                piece = word[a : end[nxt[a]]]
                if piece in ranks:
                    heapq.heappush(heap, (ranks[piece], a, end[nxt[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compact(ids: Column, width: int) -> Column:
    """Ids as one binary, `width` bytes each, big-endian; null stays null."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 2 * width, "0")), ""))


def planes(numbers: np.ndarray, width: int = 3) -> bytes:
    """Numbers (uint32) of `width` bytes: all lowest bytes, then the next ones, and so on; these pack better."""
    return numbers.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def from_planes(raw: bytes, width: int = 3) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(width, -1).astype(np.uint32)
    out = low[0]
    for k in range(1, width):
        out = out | low[k] << np.uint32(8 * k)
    return out


def _packed(number: np.ndarray, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """Words' numbers, which rise, how many ids each has, and the ids of `width` bytes, compressed."""
    import pyarrow as pa

    gaps = np.diff(number.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    raw = struct.pack("<Q", len(number)) + planes(gaps, 4) + planes(sizes.astype("<u4"), 4) + planes(ids.astype("<u4"), width)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=7).compress(raw, asbytes=True)


def _unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    (n,) = struct.unpack_from("<Q", raw)
    number = np.cumsum(from_planes(raw[8 : 8 + 4 * n], 4), dtype=np.int64)
    return number, from_planes(raw[8 + 4 * n : 8 + 8 * n], 4).astype(np.int64), from_planes(raw[8 + 8 * n :], width)


def _gather(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at offsets and have sizes, in that order, end to end."""
    n = sizes[order]
    ends = np.cumsum(n)
    return flat[np.repeat(offsets[order] - (ends - n), n) + np.arange(int(n.sum()))]


def slices(batches, rows: int):
    """Tables of about so many rows."""
    import pyarrow as pa

    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, ids binary (little-endian uint32), decoded binary (bytes of the decoded ids).

    Null texts count as empty and have no ids. pattern splits a text into words; every word is encoded on its own,
    without special tokens. Whole texts are encoded, however long. Repeated rows are documents of their own, a null
    doc_id stays null, other columns are not read, and an empty table gives an empty table.
    """
    return _mapped(docs, rank_path, pattern, text, doc_id, False)


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """encode_documents with n_tokens, and the SHA-256 of ids and of decoded bytes in place of these."""
    return _mapped(docs, rank_path, pattern, text, doc_id, True)


def _mapped(docs: DataFrame, rank_path: str, pattern: str, text: str, doc_id: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    split = own.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0)).alias("words"))

    def number(batches):
        """Documents as numbers of their block's words, most frequent first, and the words: two kinds of rows in one pass."""
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["block", "doc_id", "numbers", "first", "words", "kind"]
        block, known, held = TaskContext.get().partitionId() << 20, {}, []

        def ended():
            """The block's rows."""
            n = np.bincount(np.concatenate([x for _, own in held for x in own] or [np.zeros(0, "<u4")]), minlength=len(known))
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(n), dtype="<u4")
            rank[order] = np.arange(len(n))
            for doc_ids, own in held:
                k = len(own)
                rows = pa.array([planes(rank[x]) for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), doc_ids, rows, pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.string())), pa.array(np.zeros(k, np.int32))], names)
            words = list(known)
            words = [words[i] for i in order.tolist()]
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at], pa.int64()), pa.array([words[at : at + 50_000]], pa.list_(pa.string())), pa.array([1], pa.int32())], names)

        size = 0
        for b in batches:
            words = b.column("words")
            ends = words.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < b.num_rows:  # rows of about SLICE words at once
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                flat = words.slice(at, to - at).flatten().dictionary_encode()
                places = np.array([known.setdefault(w, len(known)) for w in flat.dictionary.to_pylist()] or [0], dtype="<u4")
                of_words = places[flat.indices.to_numpy(zero_copy_only=False)]
                cuts = (ends[at : to + 1] - ends[at]).tolist()
                held.append((b.column("doc_id").slice(at, to - at), [of_words[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]))
                size += len(of_words)
                at = to
                if len(known) >= BLOCK_WORDS or size >= 8 * SLICE:
                    yield from ended()
                    block, known, held, size = block + 1, {}, [], 0
        yield from ended()

    path = new_path(spark, "numbered")
    split.mapInArrow(lean(number), "block long, doc_id long, numbers binary, first long, words array<string>, kind int").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    both = spark.read.schema("block long, doc_id long, numbers binary, first long, words array<string>, kind int").parquet(path)
    numbered, lists = both.where("kind = 0").select("block", "doc_id", "numbers"), both.where("kind = 1").select("block", "first", "words")
    ranks = load_ranks(rank_path)
    width = 2 if max(ranks.values()) < 1 << 16 else 4
    folder = new_path(spark, "dictionaries")

    def bundle(batches):
        """One row per block for many words: their numbers and ids."""
        import pyarrow as pa

        own = None
        for t in slices(batches, 400_000):
            place, blobs = t.column("place").to_numpy(), t.column("ids").to_pylist()
            if t.column("ids").null_count:  # words that are too long for the fold
                own = own or load_ranks(rank_path)
                for i in np.flatnonzero(t.column("ids").is_null().to_numpy(zero_copy_only=False)).tolist():
                    blobs[i] = np.array(merged(t.column("word")[i].as_py().encode("utf-8"), own), dtype=f">u{width}").tobytes()
            order = np.argsort(place, kind="stable")
            place, blobs = place[order], [blobs[i] for i in order.tolist()]
            block = place >> PLACES
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            packed = [_packed(place[a:z] & ((1 << PLACES) - 1), np.fromiter(map(len, blobs[a:z]), dtype=np.int64, count=z - a) // width, np.frombuffer(b"".join(blobs[a:z]), f">u{width}"), width) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]
            firsts = block[[a for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]]
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(packed, pa.binary())], ["block", "bundle"])

    def write(batches):
        import pyarrow as pa

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        for t in groups(batches, ("block",)):
            starts = group_starts(t, ("block",)).tolist()
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                parts, name = [_unpacked(x, width) for x in t.column("bundle").slice(s, e - s).to_pylist()], t.column("block")[s].as_py()
                number, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(number, kind="stable")
                with fs.open_output_stream(f"{path}/.{name}") as f:
                    f.write(_packed(number[order], sizes[order], _gather(ids, np.cumsum(sizes) - sizes, sizes, order), width))
                fs.move(f"{path}/.{name}", f"{path}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64())], ["block"])

    # a word's list of places is as long as the number of blocks at most; each word is encoded once, in one task
    places = lists.select("block", "first", F.posexplode("words").alias("k", "word")).select("word", F.shiftleft("block", PLACES).bitwiseOR(F.col("first") + F.col("k")).alias("place"))
    words = places.groupBy("word").agg(F.collect_list("place").alias("places"))
    short = F.octet_length("word") <= FOLD_BYTES
    folded = F.when(short, compact(encoded(F.col("word"), literal_ranks(ranks)), width))
    dealt = words.select("places", folded.alias("ids"), F.when(~short, F.col("word")).alias("word")).select(F.explode("places").alias("place"), "word", "ids")
    blocks = max(1, lists.select("block").distinct().count())
    ready = dealt.mapInArrow(lean(bundle), "block long, bundle binary").repartition(blocks, "block").sortWithinPartitions("block")
    stored(ready.mapInArrow(lean(write), "block long"), "dictionary-list")

    def encode(batches):
        import pyarrow as pa

        fs, path = file_system(folder)
        pieces = {v: k for k, v in load_ranks(rank_path).items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        last, sizes, offsets, ids = None, None, None, None
        for b in batches:
            at = b.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) if len(at) else [0, 0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                rows = b.column("numbers").slice(s, e - s).to_pylist()
                counts = np.array([len(r) // 3 for r in rows], dtype=np.int64)
                if counts.any() and at[s] != last:
                    with fs.open_input_file(f"{path}/{at[s]}") as f:
                        _, sizes, ids = _unpacked(f.read(), width)
                    last, offsets = at[s], np.cumsum(sizes) - sizes
                done = np.concatenate([[0], np.cumsum(counts)])
                k = 0
                while k < len(rows):  # documents of about SLICE words at once
                    to = max(k + 1, int(np.searchsorted(done, done[k] + SLICE, "right")) - 1)
                    own = np.concatenate([from_planes(r) for r in rows[k:to]])
                    n = sizes[own] if len(own) else np.zeros(0, np.int64)
                    flat = _gather(ids, offsets, sizes, own) if len(own) else np.zeros(0, "<u4")
                    upto = np.concatenate([[0], np.cumsum(n)])[done[k : to + 1] - done[k]].tolist()
                    texts = [flat[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]
                    plain = [b"".join(map(table.__getitem__, x.tolist())) for x in texts]
                    if digests:
                        cols = [pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in texts]), pa.array([hashlib.sha256(x).hexdigest() for x in plain])]
                    else:
                        cols = [pa.array([x.tobytes() for x in texts], pa.binary()), pa.array(plain, pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s + k, to - k), *cols], ["doc_id", *(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])
                    k = to

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary"
    return numbered.mapInArrow(lean(encode), schema)
