"""Tensor files and export headers against files made by hand, and round trips."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.operators import metrics, runs
from decklake.sources import binary


@pytest.fixture(autouse=True)
def registered(spark):
    binary.register(spark)


def file_of(tensors):
    header, at = {"__metadata__": {"format": "x"}}, 0
    for name, kind, shape, raw in tensors:
        header[name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(t[3] for t in tensors)


def whole(df):
    out = {}
    for r in df.orderBy("name", "start").collect():
        assert r.start == len(out.get(r.name, []))
        out.setdefault(r.name, []).extend(r["values"])
    return out


def test_kinds_and_pieces(spark, tmp_path):
    x = np.array([0.0, -1.5, 3.25, 65504.0, 1e-3])
    bf16 = (np.array([1.0, -2.5, 3.0], np.float32).view(np.uint32) >> 16).astype("<u2")
    tensors = [("f64", "F64", [5], x.tobytes()), ("f32", "F32", [5], x.astype("<f4").tobytes()), ("f16", "F16", [1, 5], x.astype("<f2").tobytes()), ("bf16", "BF16", [3], bf16.tobytes())]
    tensors += [("i64", "I64", [2], np.array([2**53, -1], "<i8").tobytes()), ("u8", "U8", [3], bytes([0, 7, 255])), ("bool", "BOOL", [2], bytes([1, 0])), ("none", "F32", [0], b""), ("one", "F32", [], np.float32(4).tobytes())]
    (tmp_path / "b.safetensors").write_bytes(file_of(tensors))
    (tmp_path / "a.safetensors").write_bytes(file_of([("other", "I32", [2, 2], np.arange(4, dtype="<i4").tobytes())]))
    (tmp_path / "notes.txt").write_text("no tensors")
    for piece, range_ in ((8 << 20, 64 << 20), (8, 16)):
        df = spark.read.format("tensors").option("piece", piece).option("range", range_).load(str(tmp_path))
        got = whole(df)
        assert got["f64"] == x.tolist() and got["f32"] == x.astype("<f4").tolist() and got["f16"] == x.astype("<f2").tolist() and got["bf16"] == [1.0, -2.5, 3.0]
        assert got["i64"] == [2.0**53, -1.0] and got["u8"] == [0, 7, 255] and got["bool"] == [1, 0] and got["none"] == [] and got["one"] == [4.0] and got["other"] == [0, 1, 2, 3]
        assert {r.name: list(r["shape"]) for r in df.collect()}["other"] == [2, 2]
    assert df.rdd.getNumPartitions() > 5
    assert spark.read.format("tensors").load(f"file://{tmp_path}/a.safetensors").count() == 1


def test_round_trip(spark, tmp_path):
    rows = [(f"t{k}", kind, [k % 4, 2], [v / 8 for v in range(2 * (k % 4))]) for k, kind in enumerate(["F64", "F32", "F16", "BF16"] * 25)]
    df = spark.createDataFrame(rows, "name string, kind string, shape array<long>, values array<double>").repartition(6)
    df.write.format("tensors").mode("overwrite").save(str(tmp_path))
    back = spark.read.format("tensors").load(str(tmp_path))
    assert {(r.name, r.kind, tuple(r["shape"]), tuple(r["values"])) for r in back.collect()} == {(n, k, tuple(s), tuple(v)) for n, k, s, v in rows}
    (tmp_path / "left-by-a-dead-task.safetensors").write_bytes(file_of([("ghost", "F32", [1], np.float32(1).tobytes())]))
    assert spark.read.format("tensors").load(str(tmp_path)).where("name = 'ghost'").count() == 0
    df.limit(1).withColumn("name", F.lit("more")).write.format("tensors").mode("append").save(str(tmp_path))
    assert spark.read.format("tensors").load(str(tmp_path)).select("name").distinct().count() == len(rows) + 1


def test_bfloat_is_rounded_to_the_nearest():
    x = np.array([1.0, 1.00390625, 1.01171875, -3.14159], np.float64)
    got = binary.decoded(binary.encoded(x, "BF16"), "BF16")
    assert got.tolist() == [1.0, 1.0, 1.015625, -3.140625]


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("tensors").load(f"{tmp_path}/nowhere").count()
    assert spark.read.format("tensors").load(str(tmp_path)).count() == 0
    assert spark.read.format("exports").load(str(tmp_path)).count() == 0


def test_changes_of_pieces(spark):
    schema = "name string, start long, values array<double>"
    a = spark.createDataFrame([("x", 0, [1.0, 2.0]), ("x", 2, [3.0]), ("y", 0, [1.0]), ("z", 0, [1.0])], schema)
    b = spark.createDataFrame([("x", 0, [1.0, 2.5]), ("x", 2, [3.25]), ("y", 0, [1.0]), ("y", 1, [2.0]), ("w", 0, [1.0])], schema)
    got = {r.name: (r.in_both, r.max_diff) for r in metrics.tensor_changes(a, b).collect()}
    assert got == {"x": (True, 0.5), "y": (False, None), "z": (False, None), "w": (False, None)}


def export(keys, tensors=(), version=3):
    """An export's header by hand: keys of (name, kind number, packed value)."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", version, len(tensors), len(keys))
    for name, kind, raw in keys:
        out += text(name) + struct.pack("<I", kind) + raw
    for name, shape in tensors:
        out += text(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, 0, 1 << 40)
    return out


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def test_headers(spark, tmp_path):
    arch = ("general.architecture", 8, text("gra\"ñ"))
    heads = ("gra\"ñ.attention.head_count_kv", 9, struct.pack("<IQ3i", 5, 3, 8, 0, 0))
    words = ("tokenizer.words", 9, struct.pack("<IQ", 8, 2) + text("a") + text("ñ"))
    numbers = [(f"n{k}", k, struct.pack("<" + c, v)) for k, c, v in ((0, "B", 200), (1, "b", -5), (2, "H", 60000), (3, "h", -7), (4, "I", 2**32 - 1), (5, "i", -9), (6, "f", 0.5), (7, "?", True), (10, "Q", 2**64 - 1), (11, "q", -(2**63)), (12, "d", 0.1))]
    nested = ("nested", 9, struct.pack("<IQ", 9, 1) + struct.pack("<IQ2B", 0, 2, 1, 2))
    (tmp_path / "bad.gguf").write_bytes(export([arch, heads, words, nested, *numbers], [("blk.0.k", [4, 2])]) + b"\0" * 100)
    (tmp_path / "good.gguf").write_bytes(export([arch, heads, ("tokenizer.chat_template", 8, text("{{ x }}"))], [("blk.0.ssm_in", [1]), ("o", [])]))
    (tmp_path / "bare.gguf").write_bytes(export([], [], 2))
    keys, tensors = (spark.read.format("exports").option("part", part).load(str(tmp_path)) for part in ("keys", "tensors"))
    got = {r.key: (r.kind, json.loads(r.value)) for r in keys.where("path like '%bad%'").collect()}
    assert got["general.architecture"] == ("string", "gra\"ñ") and got["tokenizer.words"] == ("array", ["a", "ñ"]) and got["nested"] == ("array", [[1, 2]])
    assert [got[f"n{k}"][1] for k in (0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12)] == [200, -5, 60000, -7, 2**32 - 1, -9, 0.5, True, 2**64 - 1, -(2**63), 0.1]
    assert {(r.name, tuple(r["shape"]), r.offset) for r in tensors.collect()} == {("blk.0.k", (4, 2), 1 << 40), ("blk.0.ssm_in", (1,), 1 << 40), ("o", (), 1 << 40)}
    found = {r.path.rsplit("/", 1)[1]: (r.arch, r.tensors, r.ssm, r.recurrent, r.template, r.valid) for r in runs.exports(keys, tensors).collect()}
    assert found == {"bad.gguf": ("gra\"ñ", 1, 0, 2, False, False), "good.gguf": ("gra\"ñ", 2, 1, 2, True, True)}


@pytest.mark.parametrize("raw, why", [(b"XXXX" + b"\0" * 30, "not an export"), (export([], [], 1), "first version"), (export([("k", 8, text("abc")[:-1])]), "ends early"), (export([("k", 77, b"")]), "unknown kind")])
def test_broken_headers_are_errors(spark, tmp_path, raw, why):
    (tmp_path / "x.gguf").write_bytes(raw)
    with pytest.raises(Exception, match=why):
        spark.read.format("exports").load(str(tmp_path)).collect()
