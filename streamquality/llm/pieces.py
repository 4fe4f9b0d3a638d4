"""Splitting text for byte-level tokenizers, with bounded caches of pieces already encoded.

Between two characters that are no white space, a single space always starts a new piece, and
any other single white-space character is a piece of its own. So such a text falls apart into
space-led chunks that are encoded one by one, and most chunks of a corpus were seen before.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Stands for the ids of a chunk that can't be encoded by itself; no ids have this length.
_ODD = b"odd"
#: Longer pieces and chunks (characters) are encoded each time, so that a cache's bytes are bounded.
LONG = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where a piece begins in any case."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class _Cache(dict):
    """Key -> ids as little-endian bytes, computed when first asked for. A full table starts anew."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PieceEncoder:
    """Encodes texts with ``piece_ids``, which gives the ids of one match of ``pattern``: the
    split of byte-level vocabularies, in which a space and the letters after it are one piece,
    and so is a full stop or comma after letters. ``limit`` chunks are remembered, some 200 bytes
    each, and longer ones not at all."""

    def __init__(self, pattern: str, piece_ids: Callable[[str], list[int]], limit: int = 200_000):
        self.find = regex.compile(pattern).findall
        pieces = self.pieces = _Cache(lambda p: array("I", piece_ids(p)).tobytes(), limit // 8)
        self.plain = lambda part: b"".join([pieces[p] if len(p) <= LONG else array("I", piece_ids(p)).tobytes() for p in self.find(part)])

        def chunk(c: str) -> bytes:
            if c.isalpha():
                return array("I", piece_ids(" " + c)).tobytes()
            if c[-1:] in (".", ",") and c[:-1].isalpha():
                return chunks[c[:-1]] + pieces[c[-1]]
            if not c or len(c.split()) != 1 or c[-1].isspace() or (c[0] != "\n" and c[0].isspace()):
                return _ODD
            return self.plain(c if c[0] == "\n" else " " + c)
        chunks = self.chunks = _Cache(chunk, limit)

    def forget(self) -> None:
        self.pieces.clear()
        self.chunks.clear()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.plain, segments(text))), "<u4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks are split off and told apart by Arrow; Python looks at each
        distinct one once. A text with an odd chunk (other white space, or several in a row) is
        split as a whole instead."""
        firsts, rests = [], []
        for text in texts:
            first, space, rest = text.replace("\n", " \n").partition(" ")
            firsts.append(first)
            rests.append(rest if space else None)
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        parts = [self.chunks[c] if len(c) <= LONG else self.chunks.compute(c) for c in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        odd = sizes % 4 > 0
        for k in np.flatnonzero(odd):
            parts[k] = b""
        sizes = np.where(odd, 0, sizes // 4)
        ids = pa.array(np.frombuffer(b"".join(parts), "<u4"))
        ends = np.cumsum(sizes[codes])
        flat = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], ids).take(coded.indices).flatten().to_numpy()
        last = np.cumsum(counts)
        odds = np.r_[0, np.cumsum(odd[codes])][np.stack([last - counts, last])] if len(codes) else np.zeros((2, len(texts)), int)
        bounds = np.r_[0, ends][np.stack([last - counts, last])] if len(codes) else np.zeros((2, len(texts)), int)
        out = []
        for text, first, a, b, x, y in zip(texts, firsts, *bounds.tolist(), *odds.tolist()):
            if x != y or len(first.split()) != bool(first) or (first and (first[0].isspace() or first[-1].isspace())):
                out.append(self.encode(text))
            elif first:
                out.append(np.concatenate([np.frombuffer(self.plain(first), "<u4"), flat[a:b]]))
            else:
                out.append(flat[a:b])
        return out
