"""Plain renderings of the formulas, for small inputs only."""

from __future__ import annotations

import math
from collections import Counter


def esr(pixels):
    n = len(pixels)
    counts = Counter(pixels).values()
    base = 1 - (2 * n // 3) / n
    return math.sqrt(sum(c * (c - 1) for c in counts) / (n * (n - 1)) * sum(1 - base ** c for c in counts))


def mesr(pixels, size):
    got = [esr(pixels[i:i + size]) for i in range(0, len(pixels) - size + 1, size)]
    return sum(got) / len(got) if got else None


def kept(scores, share, block):
    out = []
    for start in range(0, len(scores), block):
        part = scores[start:start + block]
        order = sorted(range(len(part)), key=lambda i: (part[i], i))
        out += sorted(start + i for i in order[:max(1, int(round(len(part) * share)))])
    return out
