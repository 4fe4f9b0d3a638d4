"""Token-id files: fixed-width bit packing in blocks, with random access.

A file holds, little-endian: the packed blocks, each of ``block`` ids of ``bits`` bits and padded
to a whole byte; then its index: keys of the documents (int64) with a flag for null ones, the
position of each document's first id (uint64), the byte offset of each block (uint64); then a
tail of fixed size. A folder holds such files and ``manifest.json``, which names them in order
with the ids before each. Files of failed or repeated tasks are not in the manifest.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

FORMAT = "token_files"
BLOCK = 4096
_TAIL = struct.Struct("<QQQII8s")
_MAGIC = b"TOKFILE1"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first, without gaps, padded to a byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class _FileWriter:
    """Writes one file from whole documents in order; holds less than a block of ids."""

    def __init__(self, sink, bits: int, block: int):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.keys, self.nulls, self.starts, self.offsets = [], [], [], []
        self.n = self.at = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(self.rest) // self.block * self.block
        for k in range(0, whole, self.block):
            self._put(self.rest[k:k + self.block])
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        for values, kind in ((self.keys, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(_TAIL.pack(len(self.keys), self.n, len(self.offsets), self.bits, self.block, _MAGIC))
        self.sink.close()


class TokenFile:
    """Random access to one file: reads its index, then only the blocks that are asked for."""

    def __init__(self, fs: FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        docs, self.n, blocks, self.bits, self.block, magic = _TAIL.unpack(
            self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        index = self.file.read_at(17 * docs + 8 * blocks, size - _TAIL.size - 17 * docs - 8 * blocks)
        self.keys = np.frombuffer(index, "<i8", docs)
        self.nulls = np.frombuffer(index, "u1", docs, 8 * docs)
        self.starts = np.append(np.frombuffer(index, "<u8", docs, 9 * docs), np.uint64(self.n)).astype(np.int64)
        ends = size - _TAIL.size - len(index)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks, 17 * docs), np.uint64(ends)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - at, at)
        if self.bits * self.block % 8 == 0:
            ids = unpack(data, self.bits, min(self.n, (last + 1) * self.block) - first * self.block)
        else:
            ids = np.concatenate([
                unpack(data[int(self.offsets[b]) - at:int(self.offsets[b + 1]) - at], self.bits,
                       min(self.n, (b + 1) * self.block) - b * self.block) for b in range(first, last + 1)])
        return ids[start - first * self.block:stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


@dataclass
class _Written(WriterCommitMessage):
    order: int
    name: str | None
    ids: int


@dataclass
class _File(InputPartition):
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, block: int):
        self.path, self.bits, self.block = path, bits, block

    def write(self, iterator):
        order, fs_path, out, name = TaskContext.get().partitionId(), None, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs, fs_path = FileSystem.from_uri(self.path)
                fs.create_dir(fs_path, recursive=True)
                name = f"{order:06d}-{uuid.uuid4().hex}.tok"
                out = _FileWriter(fs.open_output_stream(f"{fs_path}/{name}"), self.bits, self.block)
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for key, a, b in zip(batch.column(0).to_pylist(), offsets, offsets[1:]):
                out.add(key, values[a:b])
        if out:
            out.close()
        return _Written(order, name, out.n if out else 0)

    def commit(self, messages):
        fs, path = FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        files, before = [], 0
        for m in sorted((m for m in messages if m.name), key=lambda m: m.order):
            files.append({"name": m.name, "start": before, "ids": m.ids})
            before += m.ids
        with fs.open_output_stream(f"{path}/manifest.json") as f:
            f.write(json.dumps({"bits": self.bits, "block": self.block, "files": files}).encode())

    def abort(self, messages):
        fs, path = FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, path = FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            files = json.loads(f.read())["files"]
        return [_File(x["name"], x["start"]) for x in files] or [_File("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        fs, path = FileSystem.from_uri(self.path)
        file = TokenFile(fs, f"{path}/{partition.name}")
        first, docs = 0, len(file.keys)
        while first < docs:  # about a million ids at a time, or one document
            stop = max(first + 1, int(np.searchsorted(file.starts, file.starts[first] + (1 << 20))) - 1)
            stop = min(stop, docs)
            starts = file.starts[first:stop + 1]
            ids = file.ids(int(starts[0]), int(starts[-1]))
            lists = pa.ListArray.from_arrays((starts - starts[0]).astype(np.int32), pa.array(ids.astype(np.int32)))
            keys = pa.array(file.keys[first:stop], mask=file.nulls[first:stop].astype(bool))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts[:-1] + partition.start), lists],
                                             ["doc_id", "start", "ids"])
            first = stop


class TokenFiles(DataSource):
    """``df.write.format("token_files").option("bits", ...).save(uri)`` takes rows (key long, ids
    array<int>) that are in order within and across partitions; reading gives ``doc_id, start,
    ids``. The folder must be one that every executor reaches, under a scheme that Arrow knows
    (file, hdfs, s3, gs)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "doc_id long, start long, ids array<int>"

    def _path(self) -> str:
        path = self.options["path"]
        return path if "://" in path or path.startswith("file:") else f"file://{path}"

    def writer(self, schema, overwrite):
        return _Writer(self._path().replace("file:///", "file:/").replace("file:/", "file:///"),
                       int(self.options.get("bits", 32)), int(self.options.get("block", BLOCK)))

    def reader(self, schema):
        return _Reader(self._path().replace("file:///", "file:/").replace("file:/", "file:///"))


def write_tokens(df: DataFrame, path: str, vocabulary: int, block: int = BLOCK) -> None:
    """Rows ``doc_id, ids`` in their order, as token files under ``path``. A document of no ids
    keeps its index entry; null ids fail the job."""
    df.sparkSession.dataSource.register(TokenFiles)
    (df.select("doc_id", "ids").write.format(FORMAT).mode("append").option("bits", bits_for(vocabulary))
     .option("block", block).save(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document; ``start`` counts the ids of all before it."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(path)
