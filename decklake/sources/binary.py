"""Data sources of binary model files: tensors, and the metadata of exports.

    register(spark)
    spark.read.format("tensors").load(folder)          (path, name, kind, shape, start, values): tensors in pieces
    spark.read.format("exports").load(folder)          (path, key, kind, value): a row for each key of a header
    spark.read.format("exports").option("part", "tensors").load(folder)   (path, name, kind, shape, offset)

Headers are read when the scan is planned or by the tasks that need them; bodies are read in byte ranges by the tasks that hand them on, and those
of exports never. Files are opened where the tasks run, by the file system that a path names (as pyarrow knows them)."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a tensor that a task hands on as one row, and of tensors that make a task or a written file: only a matter of memory.
PIECE, RANGE = 8 << 20, 64 << 20
#: Element kinds of a tensor file and their layout. BF16 is the upper half of F32.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
#: The mark of an export, and its kinds of values by number; 8 is a string and 9 an array.
MARK = b"GGUF"
VALUES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
NAMES = {0: "uint8", 1: "int8", 2: "uint16", 3: "int16", 4: "uint32", 5: "int32", 6: "float32", 7: "bool", 8: "string", 9: "array", 10: "uint64", 11: "int64", 12: "float64"}


def register(spark: SparkSession) -> None:
    for source in (Tensors, Exports):
        spark.dataSource.register(source)


# ---- files ----


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def _listed(path: str, ending: str) -> list[str]:
    """Files of a folder (those of its committed index, if it has one) or a file itself, as full paths in order."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    index = f"{inner.rstrip('/')}/index.json"
    if system.get_file_info(index).type == fs.FileType.File:
        with system.open_input_stream(index) as f:
            names = json.loads(f.read())["files"]
    else:
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name.endswith(ending)]
    return [f"{path.rstrip('/')}/{name}" for name in sorted(names)]


def _put(folder: str, name: str, body: bytes) -> None:
    system, inner = _system(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner.rstrip('/')}/{name}") as f:
        f.write(body)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _FolderWriter(DataSourceWriter):
    """Files of tasks; those of the tasks that count are named in an index at the end, others are never read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def commit(self, messages) -> None:
        files = sorted(name for m in messages if m is not None for name in m.files)
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        index = f"{inner.rstrip('/')}/index.json"
        if not self.overwrite and system.get_file_info(index).type == fs.FileType.File:
            with system.open_input_stream(index) as f:
                files = sorted({*files, *json.loads(f.read())["files"]})
        _put(self.path, "index.json", json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        system, inner = _system(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            system.delete_file(f"{inner.rstrip('/')}/{name}")


# ---- tensors ----


@dataclass
class Pieces(InputPartition):
    """Byte ranges of a file: (name, kind, shape, first value, values, offset)."""

    path: str
    pieces: list[tuple]


def tensor_header(f) -> tuple[dict, int]:
    """({name: {dtype, shape, data_offsets}}, where the numbers begin)."""
    n = int.from_bytes(f.read(8), "little")
    return json.loads(f.read(n)), 8 + n


def decoded(raw: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, KINDS[kind])
    return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64) if kind == "BF16" else x.astype(np.float64)


class Tensors(DataSource):
    """Files of named tensors: eight bytes with the header's length, a JSON header, the numbers.

    A tensor comes in pieces of up to `piece` bytes: start is the place of a piece's first value. Values are doubles, which hold every kind but
    the largest 64-bit integers exactly. Writing takes rows (name, values) and any of kind (F32 if not given) and shape; each task writes
    files of up to RANGE bytes, and an index of the files ends the job."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "path string, name string, kind string, shape array<bigint>, start bigint, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TensorWriter(self.options, overwrite)


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.piece, self.range = options["path"], int(options.get("piece", PIECE)), int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _listed(self.path, ".safetensors"):
            system, inner = _system(path)
            with system.open_input_stream(inner) as f:
                header, base = tensor_header(f)
            held, size = [], 0
            for name, entry in sorted(((k, v) for k, v in header.items() if k != "__metadata__"), key=lambda kv: kv[1]["data_offsets"]):
                kind, (begin, end) = entry["dtype"], entry["data_offsets"]
                width = np.dtype(KINDS[kind]).itemsize
                step = max(1, self.piece // width)
                total = (end - begin) // width
                for first in range(0, total, step) if total else [0]:
                    n = min(step, total - first)
                    if held and size + n * width > self.range:
                        out.append(Pieces(path, held))
                        held, size = [], 0
                    held.append((name, kind, entry["shape"], first, n, base + begin + first * width))
                    size += n * width
            if held:
                out.append(Pieces(path, held))
        return out or [Pieces("", [])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            return
        system, inner = _system(partition.path)
        with system.open_input_file(inner) as f:
            for name, kind, shape, first, n, offset in partition.pieces:
                f.seek(offset)
                values = decoded(f.read(n * np.dtype(KINDS[kind]).itemsize), kind)
                cols = [pa.array([partition.path]), pa.array([name]), pa.array([kind]), pa.array([shape], pa.list_(pa.int64())), pa.array([first], pa.int64())]
                cols.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values)))
                yield pa.RecordBatch.from_arrays(cols, names=["path", "name", "kind", "shape", "start", "values"])


def tensor_file(tensors: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """A file of (name, kind, shape, numbers)."""
    header, at = {}, 0
    for name, kind, shape, raw in tensors:
        header[name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps(header, ensure_ascii=False).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(raw for *_, raw in tensors)


def encoded(values, kind: str) -> bytes:
    x = np.asarray(values, np.float64)
    if kind != "BF16":
        return x.astype(KINDS[kind]).tobytes()
    bits = x.astype(np.float32).view(np.uint32)
    # to the nearest, ties to even
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2").tobytes()


class TensorWriter(_FolderWriter):
    def write(self, iterator) -> Written:
        done, held, names, size = [], [], set(), 0

        def flush() -> None:
            nonlocal held, size
            if held:
                done.append(f"part-{uuid.uuid4().hex}.safetensors")
                _put(self.path, done[-1], tensor_file(held))
            held, size = [], 0
            names.clear()

        for row in iterator:
            x = row.asDict()
            kind = x.get("kind") or "F32"
            raw = encoded(x["values"] or [], kind)
            if held and (size + len(raw) > RANGE or x["name"] in names):
                flush()
            names.add(x["name"])
            held.append((x["name"], kind, list(x.get("shape") or [len(x["values"] or [])]), raw))
            size += len(raw)
        flush()
        return Written(done)


# ---- exports ----


@dataclass
class Header(InputPartition):
    paths: list[str]


class _Fields:
    """Reads the fields of an export's header one after the other."""

    def __init__(self, f):
        self.f = f

    def take(self, n: int) -> bytes:
        raw = self.f.read(n)
        if len(raw) < n:
            raise ValueError("the header ends early")
        return raw

    def number(self, code: str):
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.number("Q")).decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == STRING:
            return self.text()
        if kind == ARRAY:
            of, n = self.number("I"), self.number("Q")
            return [self.value(of) for _ in range(n)]
        if kind not in VALUES:
            raise ValueError(f"unknown kind of value: {kind}")
        return self.number(VALUES[kind])


def export_header(f) -> tuple[list[tuple[str, str, object]], list[tuple[str, list[int], int, int]]]:
    """([(key, kind, value)], [(name, shape, kind, offset)]) of an export; what follows the header is not read."""
    fields = _Fields(f)
    if fields.take(4) != MARK:
        raise ValueError("not an export")
    if fields.number("I") < 2:
        raise ValueError("exports of the first version are not read")
    n_tensors, n_keys = fields.number("Q"), fields.number("Q")
    keys = []
    for _ in range(n_keys):
        key, kind = fields.text(), fields.number("I")
        keys.append((key, NAMES.get(kind, str(kind)), fields.value(kind)))
    tensors = []
    for _ in range(n_tensors):
        name, n = fields.text(), fields.number("I")
        shape = [fields.number("Q") for _ in range(n)]
        tensors.append((name, shape, fields.number("I"), fields.number("Q")))
    return keys, tensors


def export_file(keys: list[tuple[str, str, object]], tensors: list[tuple[str, list[int], int]]) -> bytes:
    """The header of an export (version 3) with these keys and tensors, whose numbers are not in it."""
    codes = {name: code for code, name in NAMES.items()}

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    def value(kind: str, v) -> bytes:
        if kind == "string":
            return text(v)
        if kind == "array":
            of = "string" if v and isinstance(v[0], str) else "float32" if any(isinstance(x, float) for x in v) else "int32"
            return struct.pack("<IQ", codes[of], len(v)) + b"".join(value(of, x) for x in v)
        return struct.pack("<" + VALUES[codes[kind]], v)

    out = [MARK, struct.pack("<IQQ", 3, len(tensors), len(keys))]
    out += [text(k) + struct.pack("<I", codes[kind]) + value(kind, v) for k, kind, v in keys]
    at = 0
    for name, shape, kind in tensors:
        out.append(text(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, kind, at))
        at += 32 * -(-4 * int(np.prod(shape)) // 32)
    return b"".join(out)


class Exports(DataSource):
    """Headers of exported models. part: `keys` (a row a key, its value as JSON) or `tensors` (a row a tensor).

    Writing takes rows (file, keys: array of (key, kind, value as JSON), tensors: array of (name, shape, kind)), a header file each."""

    @classmethod
    def name(cls) -> str:
        return "exports"

    def schema(self) -> str:
        if self.options.get("part", "keys") == "tensors":
            return "path string, name string, kind int, shape array<bigint>, offset bigint"
        return "path string, key string, kind string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExportReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ExportWriter(self.options, overwrite)


class ExportReader(DataSourceReader):
    #: Files that one task reads.
    FILES = 100

    def __init__(self, options: dict):
        self.path, self.part = options["path"], options.get("part", "keys")

    def partitions(self) -> list[InputPartition]:
        paths = _listed(self.path, ".gguf")
        return [Header(paths[a : a + self.FILES]) for a in range(0, len(paths), self.FILES)] or [Header([])]

    def read(self, partition: Header) -> Iterator[tuple]:
        for path in partition.paths:
            system, inner = _system(path)
            with system.open_input_stream(inner) as stream:
                keys, tensors = export_header(io.BufferedReader(stream, 1 << 16))
            if self.part == "tensors":
                yield from ((path, name, kind, shape, offset) for name, shape, kind, offset in tensors)
            else:
                yield from ((path, key, kind, json.dumps(value, ensure_ascii=False)) for key, kind, value in keys)


class ExportWriter(_FolderWriter):
    def write(self, iterator) -> Written:
        done = []
        for row in iterator:
            x = row.asDict(recursive=True)
            keys = [(k["key"], k["kind"], json.loads(k["value"])) for k in x["keys"]]
            _put(self.path, x["file"], export_file(keys, [(t["name"], t["shape"], t["kind"]) for t in x["tensors"]]))
            done.append(x["file"])
        return Written(done)
