"""Record files of serialised messages as a data source: a partition for each file, read record by record.

A record is its length (8 bytes, little-endian), a checksum of those bytes, the message, and a checksum of the message.  Checksums
are CRC-32C, masked by a rotation and a constant.  A task holds one record at a time, however large the file is.

Named fields of a message are decoded from the wire format by their numbers, without a schema compiler: a path of field numbers leads
through nested messages to a value.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the format.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
KINDS = {"long": "bigint", "bool": "boolean", "double": "double", "float": "double", "string": "string", "bytes": "binary"}


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()


def _advanced(state: int, zeros: int) -> int:
    """A state after so many zero bytes, by the linearity of the code: powers of two of bytes at a time."""
    images = np.array([1 << i for i in range(32)], np.uint32)
    images = TABLE[images & 0xFF] ^ (images >> np.uint32(8))
    while zeros:
        if zeros & 1:
            state = int(np.bitwise_xor.reduce(images[[i for i in range(32) if state >> i & 1]])) if state else 0
        squared = [int(np.bitwise_xor.reduce(images[[i for i in range(32) if int(x) >> i & 1]])) if x else 0 for x in images]
        images, zeros = np.array(squared, np.uint32), zeros >> 1
    return state


_steps: dict[int, list[np.ndarray]] = {}


def crc32c(data: bytes) -> int:
    """CRC-32C; long messages are cut into 256 lanes that are worked on side by side and joined."""
    lanes = 256
    length = len(data) // lanes
    state = 0xFFFFFFFF
    if length >= 16:
        part = np.frombuffer(data, np.uint8, lanes * length).reshape(lanes, length).T
        each = np.zeros(lanes, np.uint32)
        for column in np.ascontiguousarray(part):
            each = TABLE[(each ^ column) & 0xFF] ^ (each >> np.uint32(8))
        if length not in _steps:
            if len(_steps) > 64:
                _steps.clear()
            images = [_advanced(1 << i, length) for i in range(32)]
            _steps[length] = [[_xor(images[8 * b : 8 * b + 8], v) for v in range(256)] for b in range(4)]
        t = _steps[length]
        for x in each.tolist():
            state = t[0][state & 255] ^ t[1][state >> 8 & 255] ^ t[2][state >> 16 & 255] ^ t[3][state >> 24] ^ x
        data = data[lanes * length :]
    table = TABLE.tolist()
    for b in data:
        state = table[(state ^ b) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def _xor(images: list[int], bits: int) -> int:
    out = 0
    for i, x in enumerate(images):
        if bits >> i & 1:
            out ^= x
    return out


def masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def framed(message: bytes) -> bytes:
    """A message as a record."""
    size = struct.pack("<Q", len(message))
    return size + struct.pack("<I", masked(size)) + message + struct.pack("<I", masked(message))


@dataclass(frozen=True)
class Field:
    """A value of a message: column name, field numbers from the message inwards, kind (of ``KINDS``), and whether it is a list."""

    name: str
    path: tuple[int, ...]
    kind: str
    repeated: bool = False


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def entries(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Field number, wire type and raw value of each entry of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if wire == 2:
                size, at = _varint(data, at)
            if size is None:
                raise ValueError(f"wire type {wire} isn't known")
            if at + size > len(data):
                raise IndexError("an entry goes beyond its message")
            value, at = data[at : at + size], at + size
        yield key >> 3, wire, value


def _plain(kind: str, wire: int, value) -> list:
    """The value, or the values of a packed list."""
    if kind == "string":
        return [value.decode()]
    if kind == "bytes":
        return [value]
    if kind in ("double", "float"):
        return list(struct.unpack(f"<{len(value) // (8 if kind == 'double' else 4)}{kind[0]}", value))
    if wire == 2:
        out, at = [], 0
        while at < len(value):
            x, at = _varint(value, at)
            out.append(x)
    else:
        out = [int.from_bytes(value, "little")] if isinstance(value, bytes) else [value]
    # integers are 64-bit two's complement
    return [bool(x) for x in out] if kind == "bool" else [x - (1 << 64) if x >> 63 else x for x in out]


def decoded(message: bytes, fields: list[Field]) -> list:
    """The fields' values; null for a single one that isn't there, of several the last; an empty list for none."""
    found: list[list] = [[] for _ in fields]

    def walk(data: bytes, wanted: list[tuple[int, tuple[int, ...]]]) -> None:
        for number, wire, value in entries(data):
            inner = []
            for k, path in wanted:
                if path[0] == number:
                    if len(path) == 1:
                        found[k] += _plain(fields[k].kind, wire, value)
                    else:
                        inner.append((k, path[1:]))
            if inner:
                walk(value, inner)

    walk(message, [(k, f.path) for k, f in enumerate(fields)])
    return [v if f.repeated else (v[-1] if v else None) for f, v in zip(fields, found, strict=True)]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordSource(DataSource):
    """Options: path (a file or a folder, searched through), suffix, fields (JSON of ``Field``s), check (false: checksums are not looked
    at), expected (how many files there have to be)."""

    @classmethod
    def name(cls) -> str:
        return "lanewise_records"

    def fields(self) -> list[Field]:
        return [Field(x["name"], tuple(x["path"]), x["kind"], x["repeated"]) for x in json.loads(self.options.get("fields", "[]"))]

    def schema(self) -> str:
        columns = [f"`{f.name}` " + (f"array<{KINDS[f.kind]}>" if f.repeated else KINDS[f.kind]) for f in self.fields()]
        return ", ".join(["path string", "record bigint", *(columns or ["payload binary"])])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options, self.fields())


class RecordReader(DataSourceReader):
    def __init__(self, options, fields: list[Field]):
        self.path, self.suffix = options["path"], options.get("suffix", ".tfrecord")
        self.check = options.get("check", "true").lower() == "true"
        self.expected = options.get("expected")
        self.fields = list(fields)

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: len(self.path) - len(path)] if "://" in self.path else ""
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and (x.path.endswith(self.suffix) or x is info))
        if self.expected is not None and len(names) != int(self.expected):
            raise ValueError(f"{self.path}: {len(names)} files, {self.expected} are expected")
        return [File(prefix + n) for n in names]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(path) as f:
            for i, message in enumerate(messages(f, partition.path, self.check)):
                yield (partition.path, i, *(decoded(message, self.fields) if self.fields else [message]))


def messages(f, name: str, check: bool = True) -> Iterator[bytes]:
    """The messages of an open record file, one after the other."""
    i = 0
    while head := _all(f, 12):
        if len(head) < 12:
            raise ValueError(f"{name}: record {i} is cut off")
        size, sum_ = struct.unpack("<QI", head)
        # before so much is read
        if check and masked(head[:8]) != sum_:
            raise ValueError(f"{name}: the length of record {i} doesn't fit its checksum")
        message, tail = _all(f, size), _all(f, 4)
        if len(message) < size or len(tail) < 4:
            raise ValueError(f"{name}: record {i} is cut off")
        if check and masked(message) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"{name}: record {i} doesn't fit its checksum")
        yield message
        i += 1


def _all(f, size: int) -> bytes:
    """``size`` bytes, or what there is up to the end; a stream may give less at a time."""
    parts = []
    while size > 0 and (part := f.read(min(size, 1 << 24))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def read_records(spark: SparkSession, path: str, fields: list[Field] | None = None, check: bool = True, expected: int | None = None) -> DataFrame:
    """path, record and payload, or the named fields, of the record files at a path.

    Files are reached through Arrow's file systems (local, and those of the usual schemes) on the executors; a damaged record fails
    its task."""
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(RecordSource.name()).option("check", str(check).lower()).option("fields", json.dumps([asdict(f) for f in fields or []]))
    if expected is not None:
        reader = reader.option("expected", expected)
    return reader.load(path)
