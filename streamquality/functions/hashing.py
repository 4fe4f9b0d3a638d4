"""Seeded pseudo-random keys that do not depend on partitioning.

``xxhash64`` is the fast default; ``md5`` gives the same draw in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def priority(*parts: Column | int | str, algorithm: str = "xxhash64") -> Column:
    """A repeatable random sort key: 52 uniform bits, exact in a double."""
    if algorithm == "md5":
        return F.conv(F.substring(F.md5(_text(parts)), 1, 13), 16, 10).cast("bigint")
    key = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(key, 12)


def word(*parts: Column | int | str, algorithm: str = "xxhash64") -> Column:
    """A uniform non-negative integer below 2**32."""
    if algorithm == "md5":
        return F.conv(F.substring(F.md5(_text(parts)), 1, 8), 16, 10).cast("bigint")
    key = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(key, 32)


def uniform(*parts: Column | int | str, algorithm: str = "xxhash64") -> Column:
    """A uniform double in (0, 1)."""
    return (word(*parts, algorithm=algorithm) + 0.5) / F.lit(4294967296.0)


def pick(k: Column, *parts: Column | int | str, algorithm: str = "xxhash64") -> Column:
    """A uniform integer in [0, k)."""
    return word(*parts, algorithm=algorithm) % k
