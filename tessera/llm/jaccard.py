"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Every text has a MinHash signature, cut into trees of DEPTH values each. Texts sorted by a tree's values are a prefix
trie: those with a common prefix lie side by side, and texts under one node are candidates. The longest prefixes match
first. How short they must get is audited: every text gets partners planted at the threshold similarity, and prefixes
shorten until the target share of these meet. Below that depth a node is shortened once more where the last
step still met texts that look alike. Nothing here grows with the square of a group on disk: a node's texts are
compared by one-byte sketches in blocks inside tasks, which hand on only a spanning forest; the shingle sets of each
candidate component are gathered once and compared in blocks, which hand on counts of links and again a spanning
forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, lean, stored

TREES, DEPTH, VALUES = 20, 6, 128
#: Rows of a block; a task holds two blocks at most.
BLOCK, SET_BLOCK = 1024, 256
_R = np.random.default_rng(20240607)
_MUL = _R.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
SLICE = 6_000_000
#: Shingles hashed at once, few enough to stay in a core's cache.
CACHED = 32_768
#: One text in so many, which is every text, gets so many planted partners; they are signed for so many texts at once.
AUDIT, PARTNERS, AUDIT_BLOCK = 1, 4, 200
#: With fewer partners than this the formula decides.
AUDITED = 1000


def shingled(texts, n: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (64-bit hashes of all shingles, shingles per text) for slices of an Arrow array of texts.

    Words are lower case and cut at ASCII white space. A text of 1 to n - 1 words has one shingle of all its words, one
    without words has none. Hashes may repeat within a text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bytes_, (bytes_[at - 1] if at else 0) + SLICE, "right")))
        own = pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.slice(at, to - at), "")))
        parts = pc.ascii_split_whitespace(own)
        coded = parts.flatten().dictionary_encode()
        word = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
        w = word[coded.indices.to_numpy(zero_copy_only=False)]
        words = np.diff(parts.offsets.to_numpy())
        words_real = np.where(pc.equal(own, "").to_numpy(zero_copy_only=False), 0, words)
        count = np.where(words_real >= n, words_real - n + 1, np.minimum(words_real, 1))
        first = np.cumsum(words) - words
        start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        left = np.repeat(np.minimum(words_real, n), count)
        h = left.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                inside = left > k
                if inside.all():
                    h = h * _P + w[start + k]
                else:
                    h = np.where(inside, h * _P + w[np.minimum(start + k, max(len(w) - 1, 0))] if len(w) else h, h)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        yield h, count
        at = to


def signatures(h: np.ndarray, count: np.ndarray, values: int = VALUES) -> np.ndarray:
    """(texts with shingles, values) uint32: the least value of each of the first `values` hash functions."""
    some = count[count > 0]
    ends, at = np.cumsum(some), 0
    out = np.empty((len(some), values), dtype=np.uint32)
    while at < len(some):
        first = int(ends[at] - some[at])
        to = max(at + 1, int(np.searchsorted(ends, first + CACHED, "right")))
        part, starts, least = h[first : ends[to - 1]], ends[at:to] - some[at:to] - first, np.empty((values, to - at), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for k in range(values):
                least[k] = np.minimum.reduceat(((part * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
        out[at:to] = least.T
        at = to
    return out


def recall_at(similarity, depth: int, trees: int = TREES):
    """The chance that two texts of that similarity share a node at that depth in one tree or more."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** trees


def first_depth(threshold: float, target: float) -> int:
    """The longest prefix that reaches the target recall at the threshold itself."""
    return next((d for d in range(DEPTH, 1, -1) if recall_at(threshold, d) >= target), 1)


def _hash(text: str | None) -> bytes | None:
    return None if text is None else hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def swaps(shingles: np.ndarray, similarity: float, draw: np.random.Generator, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """(partners, r) of the given distinct shingles to take out, and (partners, a) others to put in.

    The Jaccard similarity to what comes of it is the one asked for (three decimals), or just above it. Under four
    shingles at 0.8 there is nothing to swap: no set but an equal one is that similar.
    """
    n, per_mille = len(shingles), round(similarity * 1000)
    out = n * (1000 - per_mille) // (1000 + per_mille)
    put = 1000 * (n - out) // per_mille - n
    return draw.permuted(np.tile(shingles, (partners, 1)), axis=1)[:, :out], draw.integers(0, 1 << 63, (partners, put), dtype=np.uint64)


def partner(shingles: np.ndarray, similarity: float, draw: np.random.Generator) -> np.ndarray:
    """A set whose Jaccard similarity to the given distinct shingles is the one asked for, or just above it."""
    out, put = swaps(shingles, similarity, draw, 1)
    return np.concatenate([np.setdiff1d(shingles, out[0]), put[0]])


def longest(same: np.ndarray) -> np.ndarray:
    """The longest prefix, over all trees, of equal values in each row of `same`."""
    return np.logical_and.accumulate(same.reshape(-1, TREES, DEPTH), axis=2).sum(axis=2).max(axis=1)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest prefix, over all trees, that each signature of b shares with a."""
    return longest(a[None, : TREES * DEPTH] == b[:, : TREES * DEPTH])


def planted(sigs: np.ndarray, sets: list[np.ndarray], threshold: float, seeds: list[int]) -> list[list[int] | None]:
    """For each text, given its signature and distinct shingles, the prefixes that its planted partners share with it.

    A partner has the text's value wherever neither a shingle taken out had it nor one put in is below it, so only
    swapped shingles are hashed. None for a text with nothing to swap.
    """
    moved = [np.concatenate(swaps(x, threshold, np.random.default_rng(seed)), axis=1) for x, seed in zip(sets, seeds, strict=True)]
    sizes = np.array([x.shape[1] for x in moved], dtype=np.int64)
    least = signatures(np.concatenate([x.reshape(-1) for x in moved]), np.repeat(sizes, PARTNERS), TREES * DEPTH)
    shared = iter(longest(least > np.repeat(sigs[sizes > 0, : TREES * DEPTH], PARTNERS, axis=0)).reshape(-1, PARTNERS).tolist())
    return [next(shared) if n else None for n in sizes.tolist()]


def _signed(threshold: float) -> Callable:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, sigs, audits = b.column(1), [], []
            hashes = list(map(_hash, texts.to_pylist()))
            for h, count in shingled(texts):
                own, ends = signatures(h, count), np.cumsum(count)
                worded, first = np.flatnonzero(count), len(sigs)
                sigs += [None] * len(count)
                audits += [None] * len(count)
                for row, k in zip(own, worded.tolist(), strict=True):
                    sigs[first + k] = row.tobytes()
                sure = [j for j, k in enumerate(worded.tolist()) if int.from_bytes(hashes[first + k][:4], "big") % AUDIT == 0]
                for at in range(0, len(sure), AUDIT_BLOCK):
                    part = sure[at : at + AUDIT_BLOCK]
                    sets = [np.unique(h[ends[k] - count[k] : ends[k]]) for k in worded[part].tolist()]
                    seeds = [int.from_bytes(hashes[first + k][4:8], "big") for k in worded[part].tolist()]
                    for j, shared in zip(part, planted(own[part], sets, threshold, seeds), strict=True):
                        audits[first + int(worded[j])] = shared
            sketch = [s and np.frombuffer(s, "<u4").astype(np.uint8).tobytes() for s in sigs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sketch, pa.binary()), pa.array(audits, pa.list_(pa.int32()))], ["doc_id", "text_hash", "sig", "sketch", "met"])

    return run


def audited_depth(signed: DataFrame, threshold: float, target: float) -> tuple[int, float]:
    """(the longest prefix at which the target share of planted partners meets, that share as measured).

    signed has a row for every different text, so none is left out of the measure and copies weigh no more. With too few
    partners for one, the depth comes from the formula and the share is its value.
    """
    seen = {r[0]: r[1] for r in signed.select(F.explode("met").alias("met")).groupBy("met").agg(F.count("*")).collect()}
    n = sum(seen.values())
    if n < AUDITED:
        depth = first_depth(threshold, target)
        return depth, float(recall_at(threshold, depth))
    share = {d: sum(v for k, v in seen.items() if k >= d) / n for d in range(1, DEPTH + 1)}
    depth = next((d for d in range(DEPTH, 1, -1) if share[d] >= target), 1)
    return depth, share[depth]


def _prefixes(shortest: int) -> Callable:
    """Rows of the tries: key, the node of the shortest prefix; tail, two values that follow it; text_hash."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u4").reshape(-1, VALUES)[:, : TREES * DEPTH].reshape(-1, TREES, DEPTH).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2]).copy()
                for k in range(shortest):
                    key = (key ^ (key >> np.uint64(31))) * _P + sig[:, :, k]
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            after = [sig[:, :, k] if k < DEPTH else np.zeros(sig.shape[:2], np.uint64) for k in (shortest, shortest + 1)]
            tail = (after[0] << np.uint64(32)) | after[1]
            hashes = b.column("text_hash").take(pa.array(np.repeat(np.arange(b.num_rows), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).reshape(-1)), pa.array(tail.view(np.int64).reshape(-1)), hashes], ["key", "tail", "text_hash"])

    return run


def groups(batches, keys: tuple[str, ...]):
    """Yields batches that hold whole groups of rows sorted by keys; a group never spans two of them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        # where the last group of this batch begins
        last = b.num_rows - 1
        tail = [b.column(k)[last] for k in keys]
        same = np.ones(b.num_rows, dtype=bool)
        for k, v in zip(keys, tail, strict=True):
            same &= np.asarray(pc.equal(b.column(k), v).to_numpy(zero_copy_only=False))
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = [b.slice(cut)]
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != v for k, v in zip(keys, tail, strict=True)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups begin, and the number of rows at the end."""
    import pyarrow.compute as pc

    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        c = table.column(k)
        if n > 1:
            new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy())
    return np.append(np.flatnonzero(new), n)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable number of each of n rows linked by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _alike(least: float, shortest: int, sure: int) -> Callable:
    """Compares the sketches of each node's rows; hands on a spanning forest of the pairs that look alike.

    Rows come sorted by their values, so a node is a trie. Pairs that share `sure` values or more are compared, and
    those that share fewer only in nodes where a pair that shares no more than `sure` looks alike.
    """
    keys = ("key", "i", "j")

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, keys):
            starts = group_starts(t, keys)
            sizes = np.diff(starts)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
            block, tail = t.column("block").to_numpy(), t.column("tail").to_numpy()
            across = t.column("i").to_numpy() != t.column("j").to_numpy()
            left, right = [], []

            def compared(a, b):
                same = (sketch[a] == sketch[b]).sum(1) >= least * VALUES  # noqa: B023
                left.append(a[same])  # noqa: B023
                right.append(b[same])  # noqa: B023
                return same

            for s in np.unique(sizes[sizes > 1]):
                pair = np.triu_indices(s, 1)
                at = starts[:-1][sizes == s]
                step = max(1, 100_000 // len(pair[0]))
                for g in range(0, len(at), step):
                    last, rest = np.zeros(len(at[g : g + step]), dtype=bool), []
                    for p in range(0, len(pair[0]), 200_000):
                        a = (at[g : g + step, None] + pair[0][p : p + 200_000]).reshape(-1)
                        b = (at[g : g + step, None] + pair[1][p : p + 200_000]).reshape(-1)
                        of = np.repeat(np.arange(len(last)), len(pair[0][p : p + 200_000]))
                        shared = shortest + (tail[a] >> 32 == tail[b] >> 32) + (tail[a] == tail[b])
                        own = ~across[a] | (block[a] != block[b])
                        deep = own & (shared >= sure)
                        same = compared(a[deep], b[deep])
                        last[of[deep][same & (shared[deep] == sure)]] = True
                        rest.append((a[own & ~deep], b[own & ~deep], of[own & ~deep]))
                    for a, b, of in rest:
                        compared(a[last[of]], b[last[of]])
            label = spanning(t.num_rows, np.concatenate(left or [[]]).astype(np.int64), np.concatenate(right or [[]]).astype(np.int64))
            moved = np.flatnonzero(label != np.arange(t.num_rows))
            h = t.column("text_hash")
            yield from pa.table({"a": h.take(pa.array(moved)), "b": h.take(pa.array(label[moved]))}).to_batches()

    return run


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        sets = []
        for h, count in shingled(b.column("text")):
            ends = np.cumsum(count)
            sets += [np.unique(h[e - c : e]).tobytes() for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("root"), b.column("n"), b.column("text_hash"), pa.array(sets, pa.binary())], ["root", "n", "text_hash", "shingles"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets of distinct numbers."""
    n, sizes = len(sets), [len(s) for s in sets]
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    row, col = np.repeat(np.arange(n), sizes), place[inverse]
    row, col = row[shared[inverse]], col[shared[inverse]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, width = np.zeros((n, n), dtype=np.float64), max(64, 4_000_000 // n)
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, (c, c + width))
        m = np.zeros((n, width), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verified(per_mille: int) -> Callable:
    keys = ("root", "i", "j")

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, keys):
            starts = group_starts(t, keys).tolist()
            raw = t.column("shingles").to_pylist()
            block = t.column("block").to_numpy()
            across = t.column("i").to_numpy() != t.column("j").to_numpy()
            links, label = np.zeros(t.num_rows, dtype=np.int64), np.arange(t.num_rows)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in raw[s:e]]
                size = np.array([len(x) for x in sets])
                both = overlaps(sets)
                union = size[:, None] + size[None, :] - both
                near = 1000 * both >= per_mille * union
                np.fill_diagonal(near, False)
                if across[s]:
                    near &= block[s:e, None] != block[None, s:e]
                links[s:e] = near.sum(1)
                a, b = np.nonzero(np.triu(near))
                if len(a):
                    label[s:e] = s + spanning(e - s, a, b)
            some = pa.array(np.flatnonzero(links))
            h = t.column("text_hash")
            out = pa.table({"text_hash": h.take(some), "to": h.take(pa.array(label)).take(some), "links": pa.array(links).take(some)})
            yield from out.to_batches()

    return run


def _blocked(rows: DataFrame, key: str, most: int, *then: str) -> DataFrame:
    """Deals rows of a key with `n` rows to pairs (i <= j) of blocks of about `most` rows, sorted within partitions."""
    nb = F.ceil(F.col("n") / F.lit(most)).cast("int")
    block = F.pmod(F.xxhash64("text_hash"), nb).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    out = rows.withColumn("nb", nb).withColumn("block", block).withColumn("other", other)
    # with several blocks, a block is compared with itself once, inside the pairs (b, b)
    out = out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("nb", "other")
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", *then)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, target: float = 0.999, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, n_links, n_copies, kept, root.

    Two different texts are linked if the Jaccard similarity of their sets of five-word shingles is at least the
    threshold (three decimals). n_links counts the other texts linked directly, n_copies the rows of the same text,
    class_id is the smallest doc_id of all rows reachable over links and copies, kept marks the row of that doc_id.
    Null texts and texts without a word stand alone: class_id is their own doc_id and no copies count. Rows that repeat
    a doc_id count as copies, or as members of each class they are in, and all rows of the smallest doc_id have kept. A
    null doc_id comes last in a class. root is the smallest text hash of the class, which tells classes apart where
    doc_ids are null or repeat, and null for what stands alone. An empty table gives an empty table.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(own.mapInArrow(lean(_signed(threshold)), "doc_id long, text_hash binary, sig binary, sketch binary, met array<int>"), "signatures")
    reps = stored(signed.where("sig is not null").groupBy("text_hash").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("met").alias("met"), F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "texts")
    per_mille = round(threshold * 1000)
    least = max(0.0, threshold - 5.5 * np.sqrt(threshold * (1 - threshold) / VALUES))
    sure, _ = audited_depth(reps, threshold, target)
    shortest = max(1, sure - 1)
    nodes = stored(reps.select("sig", "text_hash").mapInArrow(_prefixes(shortest), "key long, tail long, text_hash binary"), "nodes")
    full = stored(nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full")
    # merge joins, so that the plan is the same at every size
    near = nodes.join(full.hint("merge"), "key").join(reps.select("text_hash", "sketch").hint("merge"), "text_hash")
    tries = _blocked(near, "key", BLOCK, "tail").select("key", "i", "j", "block", "tail", "text_hash", "sketch")
    edges = stored(tries.mapInArrow(lean(_alike(least, shortest, sure)), "a binary, b binary").distinct(), "candidates")
    drop(nodes, full)
    parts = stored(components(edges), "candidate-parts")
    sized = stored(parts.groupBy("root").agg(F.count("*").alias("n")), "part-sizes")
    wanted = stored(parts.join(sized, "root").select("root", "n", F.col("node").alias("text_hash")).join(reps.select("text_hash", "rep"), "text_hash"), "wanted")
    texts = own.withColumn("own", F.unhex(F.md5("text")))
    chosen = texts.join(wanted.hint("merge"), (texts["own"] == wanted["text_hash"]) & texts["doc_id"].eqNullSafe(wanted["rep"])).select("root", "n", "text_hash", "text")
    sets = chosen.mapInArrow(lean(_sets), "root binary, n long, text_hash binary, shingles binary").dropDuplicates(["text_hash"])
    ready = _blocked(sets, "root", SET_BLOCK).select("root", "i", "j", "block", "text_hash", "shingles")
    found = stored(ready.mapInArrow(lean(_verified(per_mille)), "text_hash binary, to binary, links long"), "links")
    drop(edges, parts, sized, wanted)
    classes = components(found.select(F.col("text_hash").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("text_hash"), "root")
    links = found.groupBy("text_hash").agg(F.sum("links").alias("n_links"))
    placed = reps.select("text_hash", "rep", "n_copies").join(links, "text_hash", "left").join(classes, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    placed = stored(placed, "placed")
    ids = stored(placed.groupBy("root").agg(F.min("rep").alias("class_id")), "class-ids")
    of = stored(placed.join(ids, "root").select(F.col("text_hash").alias("h"), "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "classes")
    rows = signed.select("doc_id", "text_hash", F.when(F.col("sig").isNotNull(), F.col("text_hash")).alias("k"))
    out = rows.join(of, F.col("k") == F.col("h"), "left")
    alone = F.col("h").isNull()
    return out.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        "root",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class, the one of the smallest doc_id, nulls last; columns stay as they are.

    Of rows of that doc_id in one class the smallest text hash stays, of rows that repeat that text too any one. Texts
    without a word all stay.
    """
    key, digest, own = "__tessera_key", "__tessera_hash", "__tessera_own"
    joined = jaccard_join(docs, threshold, text=text, doc_id=doc_id)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("first")
    some = joined.where("root is not null").groupBy("root").agg(first)
    keep = stored(some.select(F.col("first.doc_id").alias(key), F.col("first.text_hash").alias(digest)), "kept")
    hashed = docs.withColumn(own, F.unhex(F.md5(F.col(text))))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    matched = hashed.where(worded).join(keep, (F.col(own) == F.col(digest)) & F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "left_semi")
    return matched.dropDuplicates([own]).drop(own).unionByName(hashed.where(~worded).drop(own))
