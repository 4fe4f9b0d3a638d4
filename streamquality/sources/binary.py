"""Binary event files to rows.

Large files are read in byte ranges, so one file spreads over many tasks; bytes become words in
Arrow batches and everything after that (bit fields, filters) is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Address layout of the 346x260 sensor in version 2 files.
X_MASK, X_SHIFT = 0x003FF000, 12
Y_MASK, Y_SHIFT = 0x7FC00000, 22
P_SHIFT = 11
WIDTH, HEIGHT = 346, 260
HEADER_END = b"#End Of ASCII Header"
PACKET_HEADER = 28
RANGE = 8 << 20


def header_length(head: bytes) -> int:
    """Bytes before the first word: through the end marker, or the last leading ``#`` line."""
    at = 0
    while head[at:at + 1] == b"#":
        stop = head.find(b"\n", at)
        if stop < 0:
            return len(head)
        marked = head.startswith(HEADER_END, at)
        at = stop + 1
        if marked:
            break
    return at


def read_header(handle) -> int:
    """:func:`header_length` of an open file, however long its header is."""
    head = handle.read(1 << 16)
    while header_length(head) == len(head) and (more := handle.read(len(head))):
        head += more
    return header_length(head)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths only; the content column is never requested."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length")


def _open(path: str):
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, offset, content) of every body range, aligned to 8-byte records after the header."""
    spans = files(spark, path).select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))).alias("start"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, length, start in zip(pdf["path"], pdf["length"], pdf["start"]):
                with _open(path_) as handle:
                    begin = read_header(handle)
                    handle.seek(begin + start)
                    body = handle.read(min(size, max(0, (length - begin) // 8 * 8 - start)))
                if body:
                    yield pd.DataFrame({"path": [path_], "offset": [int(start)], "content": [body]})

    return spans.repartition(F.col("path"), F.col("start")).mapInPandas(
        load, "path string, offset bigint, content binary")


def words(ranges: DataFrame) -> DataFrame:
    """Big-endian (address, timestamp) pairs with their record number in the file."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, offset, body in zip(pdf["path"], pdf["offset"], pdf["content"]):
                pairs = np.frombuffer(body, dtype=">u4")[:len(body) // 8 * 2].reshape(-1, 2)
                yield pd.DataFrame({"path": path, "record": offset // 8 + np.arange(len(pairs)),
                                    "address": pairs[:, 0].astype("int64"),
                                    "stamp": pairs[:, 1].astype("int64")})
    return ranges.mapInPandas(split, "path string, record bigint, address bigint, stamp bigint")


def decode_v2(ranges: DataFrame) -> DataFrame:
    """Version 2 events; words that decode outside the sensor are dropped."""
    a = F.col("address")
    return words(ranges).select(
        "path", F.col("record").alias("source_idx"), F.col("stamp").alias("t_us"),
        F.shiftrightunsigned(a.bitwiseAND(F.lit(X_MASK)), X_SHIFT).cast("int").alias("x"),
        F.shiftrightunsigned(a.bitwiseAND(F.lit(Y_MASK)), Y_SHIFT).cast("int").alias("y"),
        F.shiftrightunsigned(a, P_SHIFT).bitwiseAND(F.lit(1)).cast("int").alias("p")).where(
        (F.col("x") < WIDTH) & (F.col("y") < HEIGHT))


def packet_index(spark: SparkSession, path: str) -> DataFrame:
    """Version 3.1 polarity packets: offset, overflow, count, number of the first event.

    Only the 28-byte headers are read; bodies are skipped by seeking.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, length in zip(pdf["path"], pdf["length"]):
                rows, first = [], 0
                with _open(path_) as handle:
                    at = read_header(handle)
                    while at + PACKET_HEADER <= length:
                        handle.seek(at)
                        kind, size, overflow, number = _packet_fields(handle.read(PACKET_HEADER))
                        at += PACKET_HEADER
                        if kind == 1 and size == 8 and number:
                            rows.append((path_, at, overflow, number, first))
                            first += number
                        at += size * number
                yield pd.DataFrame(rows, columns=["path", "offset", "overflow", "number", "first"])
    return files(spark, path).repartition("path").mapInPandas(
        walk, "path string, offset bigint, overflow bigint, number bigint, first bigint")


def _packet_fields(head: bytes) -> tuple[int, int, int, int]:
    kind = int(np.frombuffer(head, "<i2", 1)[0])
    ints = np.frombuffer(head, "<i4", 6, 4)
    return kind, int(ints[0]), int(ints[2]), int(ints[4])


def packet_bodies(packets: DataFrame) -> DataFrame:
    """Bodies of indexed packets, spread over tasks packet by packet."""
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, offset, overflow, number, first in pdf.itertuples(index=False):
                with _open(path) as handle:
                    handle.seek(offset)
                    body = handle.read(8 * number)
                yield pd.DataFrame({"path": [path], "first": [first], "overflow": [overflow],
                                    "content": [body]})
    return packets.repartition(F.col("path"), F.col("offset")).mapInPandas(
        load, "path string, first bigint, overflow bigint, content binary")


def decode_v31(bodies: DataFrame) -> DataFrame:
    """Version 3.1 events with the timestamp overflow applied; invalid words are dropped."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, first, overflow, body in pdf.itertuples(index=False):
                pairs = np.frombuffer(body, dtype="<u4").reshape(-1, 2)
                yield pd.DataFrame({"path": path, "source_idx": first + np.arange(len(pairs)),
                                    "overflow": overflow, "w": pairs[:, 0].astype("int64"),
                                    "stamp": pairs[:, 1].astype("int64")})
    rows = bodies.select("path", "first", "overflow", "content").mapInPandas(
        split, "path string, source_idx bigint, overflow bigint, w bigint, stamp bigint")
    field = lambda shift, mask: F.shiftrightunsigned("w", shift).bitwiseAND(F.lit(mask)).cast("int")
    return rows.where(F.col("w").bitwiseAND(F.lit(1)) == 1).select(
        "path", "source_idx",
        F.col("stamp").bitwiseOR(F.shiftleft(F.col("overflow"), 31)).alias("t_us"),
        field(17, 0x7FFF).alias("x"), field(2, 0x7FFF).alias("y"), field(1, 1).alias("p"))
