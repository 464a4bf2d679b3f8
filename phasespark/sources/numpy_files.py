"""A data source for one-dimensional arrays of .npy and .npz files, read in byte ranges by the tasks.

    spark.dataSource.register(NumpyFiles)
    spark.read.format("numpy").option("key", "x").load("/data/signal.npz")

The driver reads the header of the array only. Arrays of .npy files and stored members of archives are cut into partitions; a compressed
member has no places to start from but its own, and is one partition, inflated as a stream. A task holds ``CHUNK`` values at a time.
"""

from __future__ import annotations

import ast
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values that a task holds at a time, and bytes of a partition.
CHUNK, PARTITION = 1 << 18, 32 << 20


def opened(path: str) -> BinaryIO:
    """A file by its URI or local path, for reading at any place."""
    if "://" in path or path.startswith("file:"):
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb")


def header(file: BinaryIO) -> tuple[np.dtype, tuple[int, ...], int]:
    """The type and shape of the .npy stream that starts here, and the bytes up to its values."""
    start = file.read(8)
    if start[:6] != b"\x93NUMPY" or len(start) < 8:
        raise ValueError("not a .npy file")
    size = 2 if start[6] == 1 else 4
    n = int.from_bytes(file.read(size), "little")
    said = ast.literal_eval(file.read(n).decode("latin1" if start[6] < 3 else "utf8"))
    kind = np.dtype(said["descr"])
    if kind.kind not in "biuf":
        raise ValueError("an array of numbers is needed")
    return kind, tuple(said["shape"]), 8 + size + n


@dataclass
class Span(InputPartition):
    """Values ``first`` to ``last`` of an array whose bytes begin at ``offset``; of a compressed member, all of them."""

    offset: int
    first: int
    last: int
    packed: int = 0  # bytes of a compressed member


class Inflated:
    """The bytes of a compressed member, in order."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.left, self.inflate = file, size, zlib.decompressobj(-15)

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            more = self.inflate.unconsumed_tail
            if not more and self.left:
                more = self.file.read(min(1 << 16, self.left))
                self.left -= len(more)
            if not more:
                out += self.inflate.flush()
                break
            out += self.inflate.decompress(more, n - len(out))
        return out


class NumpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("path is needed")
        self.path, self.key, self.series = options["path"], options.get("key"), options.get("seriesid", "0")
        self.bytes = int(options.get("partitionbytes", PARTITION))
        with opened(self.path) as file:
            self.start, self.packed = self._member(file) if self._is_archive(file) else (0, 0)
            file.seek(self.start)
            self.kind, shape, self.skipped = header(Inflated(file, self.packed) if self.packed else file)
        if len(shape) != 1 or not shape[0]:
            raise ValueError("a non-empty, one-dimensional array is needed")
        self.n = shape[0]

    @staticmethod
    def _is_archive(file: BinaryIO) -> bool:
        file.seek(0)
        return file.read(2) == b"PK"

    def _member(self, file: BinaryIO) -> tuple[int, int]:
        """Where the wanted member's bytes begin, and how many they are if compressed."""
        file.seek(0)
        with zipfile.ZipFile(file) as archive:
            members = {m.filename.removesuffix(".npy"): m for m in archive.infolist()}
        if self.key is None and len(members) != 1:
            raise ValueError("a key is needed: the archive has several arrays")
        key = next(iter(members)) if self.key is None else self.key
        if key not in members:
            raise ValueError(f"the archive has no array {key}")
        m = members[key]
        if m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("members are stored or deflated")
        file.seek(m.header_offset + 26)
        name, extra = struct.unpack("<HH", file.read(4))
        return m.header_offset + 30 + name + extra, m.compress_size if m.compress_type == zipfile.ZIP_DEFLATED else 0

    def partitions(self) -> list[Span]:
        if self.packed:
            return [Span(self.start, 0, self.n, self.packed)]
        step = max(1, self.bytes // self.kind.itemsize)
        return [Span(self.start + self.skipped, i, min(i + step, self.n)) for i in range(0, self.n, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        size = self.kind.itemsize
        with opened(self.path) as raw:
            raw.seek(partition.offset + (0 if partition.packed else partition.first * size))
            file = Inflated(raw, partition.packed) if partition.packed else raw
            if partition.packed:
                header(file)
            for first in range(partition.first, partition.last, CHUNK):
                n = min(CHUNK, partition.last - first)
                held = file.read(n * size)
                if len(held) != n * size:
                    raise ValueError("the file ends before its array does")
                x = np.frombuffer(held, dtype=self.kind).astype(np.float64)
                if not np.isfinite(x).all():
                    raise ValueError("the array has values that are not finite")
                yield pa.RecordBatch.from_arrays([pa.array([self.series] * n), pa.array(np.arange(first, first + n)), pa.array(x)], names=["series_id", "t", "x"])


class NumpyFiles(DataSource):
    """Options: path; key of the array in an archive of several; seriesId; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "numpy"

    def schema(self) -> str:
        return "series_id string, t long, x double"

    def reader(self, schema) -> NumpyReader:
        return NumpyReader({k.lower(): v for k, v in self.options.items()})
