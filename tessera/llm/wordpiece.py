"""Exact and fast encoding with a lower-casing, white-space-dropping word BPE of the tokenizers library.

Words are independent of each other in such a tokenizer. A batch of texts is cut at ASCII white space and
dictionary-encoded by Arrow; each distinct piece is encoded once and its ids are gathered back with numpy. Pieces of
characters up to U+017F are split into words by a pattern equal to the tokenizer's own on that alphabet, so that
"the", "The" and "the," share one entry of a bounded table; any other piece, or one with a special token in it, is
given to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Characters for which Python's lower() and the tokenizer's agree and composition changes nothing.
_SAFE = "".join(c for c in map(chr, range(0x180)) if c != "İ")
_OF = {k: "".join(re.escape(c) for c in _SAFE if unicodedata.category(c)[0] == k) for k in "LN"}
_SPACE = "\x09-\x0d\x20\x85\xa0"
_PLAIN = re.compile(f"[{re.escape(_SAFE)}]*")
_WORDS = re.compile(f"[{_OF['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_OF['N']}]|[^{_SPACE}{_OF['L']}{_OF['N']}]+|\n")
#: Characters of text that are worked on at once.
SLICE = 16_000_000
#: Pieces whose ids are gathered at once.
GATHER = 100_000


class WordCoder:
    """Keeps the ids of up to `words` words."""

    def __init__(self, path: str, dtype: str = "<u4", words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most = Tokenizer.from_file(path), np.dtype(dtype), words
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Learns words, each of which the tokenizer takes as one."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, cuts = ids.astype(self.dtype).tobytes(), (cuts * self.dtype.itemsize).tolist()
                self.kept.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                self.kept.update((w, self._whole(w)) for w in part)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without ASCII white space."""
        joined = "\n".join(pieces)
        if not _PLAIN.fullmatch(joined) or "<|" in joined:
            plain = [bool(_PLAIN.fullmatch(x)) and "<|" not in x for x in pieces]
            if not all(plain):
                own = iter(self.pieces([x for x, p in zip(pieces, plain, strict=True) if p]))
                return [next(own) if p else self._whole(x) for x, p in zip(pieces, plain, strict=True)]
        if not pieces:
            return []
        words = _WORDS.findall(joined.lower())
        distinct = set(words)
        distinct.discard("\n")
        new = distinct.difference(self.kept)
        if len(self.kept) + len(new) > self.most:
            self.kept.clear()
            new = distinct
        self._words(list(new))
        self.kept["\n"] = b""
        coded = list(map(self.kept.__getitem__, words))
        del self.kept["\n"]
        ends = np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))
        cuts = [int(e) for e in ends[[i for i, w in enumerate(words) if w == "\n"]]] if len(pieces) > 1 else []
        raw = b"".join(coded)
        return list(map(raw.__getitem__, map(slice, [0, *cuts], [*cuts, len(raw)])))

    def _slice(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        blobs = self.pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // self.dtype.itemsize
        index = coded.indices.to_numpy(zero_copy_only=False)
        known, start, own = np.frombuffer(b"".join(blobs), dtype=self.dtype), np.cumsum(size) - size, size[index]
        ends = np.cumsum(own)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=self.dtype)
        for i in range(0, len(index), GATHER):
            n = own[i : i + GATHER]
            first, last = int(ends[i] - n[0]), int(ends[i + len(n) - 1])
            # the places in `known` of the ids of each piece, one after the other
            ids[first:last] = known[np.repeat(start[index[i : i + GATHER]] - (ends[i : i + GATHER] - n), n) + np.arange(first, last)]
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return ids, np.diff(np.concatenate([[0], ends])[offsets])

    def batch(self, texts):
        """Yields (ids of all texts of a slice, number of ids of each text); null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
            yield self._slice(texts.slice(at, to - at))
            at = to


_CODERS: dict[tuple, WordCoder] = {}


def coder(path: str, dtype: str = "<u4") -> WordCoder:
    """The coder of this worker process."""
    key = (path, dtype)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(path, dtype)
    return _CODERS[key]
