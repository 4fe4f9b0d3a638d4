"""A bitmap of fixed size over 64-bit hashes: what it doesn't hold need not be shuffled to meet a
table, however large that table is. It only spares work; what passes is joined exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the index: 2 MB.
BITS = 24


def bitmap(hashes: DataFrame, column: str) -> bytes:
    """The bits at which the high bits of ``column`` (long) point. The driver gets one row per 64 bits at most."""
    index = F.shiftrightunsigned(column, 64 - BITS)
    cells = hashes.select(F.shiftright(index, 6).cast("int").alias("block"), index.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = cells.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[[r["block"] for r in rows]] = [r["bits"] for r in rows]
    return out.tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    """One boolean per bit, for workers."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)


def passes(df: DataFrame, hashes: DataFrame) -> Callable[[Column], Column]:
    """A test for rows of ``df``: whether the bit of a hash is set, as it is for each of ``hashes`` (one long
    column). Workers get the hashes of the rows alone; the bitmap is a broadcast of fixed size."""
    packed = df.sparkSession.sparkContext.broadcast(bitmap(hashes, hashes.columns[0]))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        index = values.to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        bits = np.frombuffer(packed.value, np.uint8)
        return pd.Series((bits[(index >> np.uint64(3)).astype(np.int64)] >> (index & np.uint64(7)).astype(np.uint8)) & 1 > 0)
    return test
