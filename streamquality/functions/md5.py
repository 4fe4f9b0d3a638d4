"""MD5 of many short texts at once, for tasks that need more digests than Python makes one by one."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

CHUNK = 1 << 15  # digests made at a time: what they need stays in a core's cache
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNED = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_TAKEN = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]


def _first_words(words: list, n: int) -> np.ndarray:
    """First four digest bytes, as a big-endian number, of ``n`` messages of one block. ``words`` are the
    block's: an array, or an int where all messages agree."""
    a, b, c, d, f, g = np.empty((6, n), np.uint32)
    for x, start in zip((a, b, c, d), _START):
        x.fill(start)
    for i in range(61):  # the last three steps don't reach the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word, added = words[_TAKEN[i]], _ADDED[i]
        if isinstance(word, int):
            added = (added + word) % 2**32
        else:
            np.add(f, word, out=f)
        np.add(f, np.uint32(added), out=f)
        np.left_shift(f, np.uint32(_TURNED[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURNED[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


@lru_cache(maxsize=64)
def _tails(at: int, low: int, high: int) -> dict[int, int | np.ndarray]:
    """Words of blocks in which the digits of ``low`` to ``high - 1``, all equally long, begin at byte
    ``at``, with the mark that ends a message. 400 KB at most."""
    found: dict[int, int | np.ndarray] = {}
    digits, values = len(str(low)), np.arange(low, high)
    for j in range(digits):
        byte = (values // 10 ** (digits - 1 - j) % 10 + 48).astype(np.uint32) << np.uint32((at + j) % 4 * 8)
        found[(at + j) // 4] = found.get((at + j) // 4, 0) | byte
    end = at + digits
    found[end // 4] = found.get(end // 4, 0) | 0x80 << end % 4 * 8
    return found


def numbers(seed: int, first: np.ndarray, count: int) -> np.ndarray:
    """``int(md5(f"{seed}|{a}|{b}")[:8], 16)``: a row for each ``a`` of ``first``, a column for each ``b``
    below ``count``."""
    out = np.empty((len(first), count), np.uint32)
    leads = [f"{seed}|{a}|".encode() for a in first.tolist()]
    sizes = np.array([len(x) for x in leads])
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        if size + len(str(count)) > 55:  # more than one block
            for i in own.tolist():
                out[i] = [int.from_bytes(hashlib.md5(leads[i] + b"%d" % b).digest()[:4]) for b in range(count)]
            continue
        heads = np.frombuffer(b"".join(leads[i].ljust(64, b"\0") for i in own.tolist()), "<u4").reshape(-1, 16)
        low = 0
        while low < count:
            high = min(count, low + CHUNK, 10 ** len(str(low)))
            tails, width = _tails(size, low, high), high - low
            step = max(1, CHUNK // width)
            for at in range(0, len(own), step):
                part = heads[at:at + step]
                words: list = [0] * 16
                for w in range((size + len(str(low))) // 4 + 1):
                    head, tail = part[:, w], tails.get(w, 0)
                    if isinstance(tail, int) and (head == head[0]).all():
                        words[w] = int(head[0]) | tail
                    elif len(part) == 1:
                        words[w] = head[0] | tail
                    else:
                        words[w] = (head[:, None] | np.broadcast_to(np.asarray(tail, np.uint32), width)).ravel()
                words[14] = 8 * (size + len(str(low)))
                out[own[at:at + step], low:high] = _first_words(words, len(part) * width).reshape(-1, width)
            low = high
    return out
