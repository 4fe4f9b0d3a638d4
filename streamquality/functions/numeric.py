"""Column builders for the metric and its integer arithmetic."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, functions as F


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division of two bigint columns."""
    a = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def quota(n: Column, share: Column | float) -> Column:
    """Events kept out of a block of ``n``: half-even rounding, at least one."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("int"))


def quota_of(n: int, share: float) -> int:
    """`quota` for a literal block size."""
    return max(1, int(round(n * share)))


def block_quota(n: Column, share: float, block: int) -> Column:
    """`quota`, with the full-block value folded to a literal."""
    return F.when(n == block, F.lit(quota_of(block, share))).otherwise(quota(n, share))


def kept_total(n_events: Column, share: float, block: int) -> Column:
    """Events kept over a whole recording: full blocks in closed form plus the tail block."""
    tail = n_events % block
    return (div(n_events, block) * quota_of(block, share)
            + F.when(tail > 0, quota(tail, share)).otherwise(0)).cast("bigint")


def lowest_terms(pct: int) -> tuple[int, int]:
    """A whole-percent retention as a fraction in lowest terms."""
    g = gcd(pct, 100)
    return pct // g, 100 // g


def thinning_base(n: int) -> float:
    """1 - M/N for a slice of ``n`` events and M = floor(2n/3)."""
    return 1.0 - (2 * n // 3) / n


def esr_terms(count: str, slice_size: int) -> list[Column]:
    """Per-slice aggregates of the pixel counts: pair concentration and thinned occupancy."""
    n = F.col(count)
    pairs = float(slice_size) * float(slice_size - 1)
    return [
        (F.sum(n * (n - 1)) / F.lit(pairs)).alias("ntss"),
        F.sum(1.0 - F.pow(F.lit(thinning_base(slice_size)), n)).alias("ln"),
    ]


def blind(value: Column | str) -> Column:
    """A measured value without its last digits, which depend on the order of a sum: what values
    are ranked or compared by when only rounding may tell them apart."""
    return F.round(value, 12)


def esr(ntss: str = "ntss", ln: str = "ln") -> Column:
    return F.sqrt(F.col(ntss) * F.col(ln))


def pixel(x: str = "x", y: str = "y") -> Column:
    """One integer per pixel of a sensor up to 65,536 columns wide."""
    return F.col(y) * 65536 + F.col(x)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NULL, not an error, when a side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, in any session time zone."""
    since = f"cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
    return F.expr(f"cast(cast({since} as decimal(20, 6)) * 1000000 as bigint)")
