"""What the operators of this folder share: tables, staged results, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ship_package

#: Words are runs of anything but ASCII white space, which is also what bytes.split() takes.
SPACES = " \t\n\x0b\x0c\r"


_HELD: dict[object, object] = {}


def held(name: object, make: Callable):
    """What ``make`` gives, made once in a worker process and kept until another name is asked for:
    workers outlive stages, so the tables of one operator must not stay beside those of the next."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    _HELD.clear()


class WordHashes(dict):
    """Word -> 64-bit hash; some 15 MB at most."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_by_size(batches: Iterator[pa.RecordBatch], of: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about ``limit`` bytes of column ``of`` at most, or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(of)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, of: str,
              end: Callable[[], None] = release) -> DataFrame:
    """``fn`` on bounded Arrow batches of ``df``; ``of`` is the column whose bytes are bounded. ``end`` is
    called when a task's rows are over."""
    def run(batches):
        for part in rows_by_size(batches, of, 2 << 20):
            yield fn(part)
        end()
    return df.mapInArrow(run, schema)
