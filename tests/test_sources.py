import json

import pytest
from pyspark.sql import functions as F

from decklake.operators import features, runs, validate
from decklake.sources import records, sinks
from decklake.streaming import pairs


def chat(u, a):
    return json.dumps({"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}], "extra": 1}, ensure_ascii=False)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "train.jsonl").write_text(chat("ñ", "a1") + "\n\n" + json.dumps({"instruction": "i", "input": "x", "output": "o"}) + "\n", encoding="utf-8")
    (tmp_path / "val.jsonl").write_text(chat("v", "a2") + "\n", encoding="utf-8")
    return tmp_path


def test_readers(spark, files):
    train, val = str(files / "train.jsonl"), str(files / "val.jsonl")
    assert {(r.prompt, r.reference) for r in records.prompts(records.read_records(spark, train)).collect()} == {("ñ", "a1"), ("i\n\nx", "o")}
    pool = records.pool(spark, train, val).orderBy("seq")
    assert [(m[0].content if m else None) for m in (r.messages for r in pool.collect())] == ["ñ", None, "v"]
    assert records.load_splits(spark, train, val).groupBy("split").count().count() == 2
    assert records.read_records(spark, train, limit_lines=2).count() == 1
    assert records.count_lines(spark, train) == 3
    with pytest.raises(Exception, match="broken record"):
        records.read_records(spark, train, strict=True).select("messages").collect()


def test_config_inheritance(tmp_path):
    (tmp_path / "base.yaml").write_text("a:\n  b: 1\n  c: [1, x]\nd: true # note\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\na:\n  b: 2\n")
    assert records.load_config(str(tmp_path / "own.yaml")) == {"a": {"b": 2, "c": [1, "x"]}, "d": True}
    assert records.simple_yaml("k: 'q'\nm:\n  n: 1.5\n") == {"k": "q", "m": {"n": 1.5}}


def test_contract():
    assert not records.check_version(records.CONTRACT)
    with pytest.raises(ValueError):
        records.check_version(records.CONTRACT, strict=True)
    assert records.first_of(lambda: None, lambda: records.CONTRACT) is records.CONTRACT


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "ñ", None), ("val", "b", "x")], "split string, text string, error string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert "\"error\":null" in "".join(p.read_text() for p in (tmp_path / "s/split=train").glob("part*"))
    sinks.write_corpus(df.coalesce(1).orderBy("text"), str(tmp_path / "c"), after="\n\n")
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part*")) == "b\n\nñ\n\n"
    sinks.write_once({"corte": 1}, str(tmp_path / "p.json"))
    with pytest.raises(FileExistsError):
        sinks.write_once({}, str(tmp_path / "p.json"))
    assert sinks.read_sidecar(str(tmp_path)) == {"use_tsd": False}
    assert sinks.write_document(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "m.json")) == {"n": 2}


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    want = []
    for k in (2, 0, 1):
        (d / f"part-{k}.txt").write_text("".join(f"{k}:{j}\n" + "\n" * (j % 3) for j in range(200 * k)))
    for k in range(3):
        want += (d / f"part-{k}.txt").read_text().split("\n")[:-1]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = records.physical_lines(spark, str(d)).orderBy("line_no").collect()
        assert [r.line_no for r in got] == list(range(len(want))) and [r.value for r in got] == want
        assert [r.value for r in records.physical_lines(spark, str(d / "part-1.txt"), limit=3).orderBy("line_no").collect()] == ["1:0", "1:1", ""]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sidecar_round_trip(tmp_path):
    sinks.write_sidecar(str(tmp_path), use_tsd=True, lam=0.5, tree="ast")
    assert sinks.read_sidecar(str(tmp_path)) == {"use_tsd": True, "lam": 0.5, "tree": "ast"}


def test_a_task_validates_several_decks_at_a_time(spark):
    import time

    def slow(deck):
        time.sleep(0.5)
        return {"n": 1}

    decks = spark.createDataFrame([(k, "x") for k in range(8)], "seq int, deck string").coalesce(1)
    began = time.perf_counter()
    assert validate.rate(validate.validated(decks, slow)).first().rate == 1.0
    assert time.perf_counter() - began < 3.5


def test_stream_is_resumed(spark, files, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    (src / "1.jsonl").write_text(chat("q", "<think>t</think>\nbeam b"))
    for n in (1, 1, 2):
        if n == 2:
            (src / "2.jsonl").write_text(chat("q", "fix f"))
        pairs.append(pairs.decks_stream(spark, str(src)).select("deck"), out, chk).awaitTermination(60)
        assert spark.read.schema("deck string").json(out).count() == n
    assert {r.deck for r in spark.read.schema("deck string").json(out).collect()} == {"beam b", "fix f"}


def test_validator_failures_become_rows(spark):
    def check(deck):
        if "boom" in deck:
            raise RuntimeError("x")
        return {"error": "bad"} if "bad" in deck else {"n": 1}

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "boom"), (4, None)], "seq int, deck string")
    got = {r.seq: (r.ok, r.error, r.result) for r in validate.validated(df, check).collect()}
    assert got == {1: (True, None, '{"n": 1}'), 2: (False, "bad", None), 3: (False, "RuntimeError: x", None), 4: (True, None, '{"n": 1}')}
    assert "cannot run" in validate.command(["/no/such/program"])("x")["error"]


def test_features_and_runs(spark):
    df = spark.createDataFrame([(0, [1, 2], [1, -100]), (0, [3], [3]), (1, [], [])], "b int, ids array<bigint>, labels array<bigint>")
    got = {(r.b, tuple(r.ids), tuple(r.labels), tuple(r["mask"])) for r in features.padded(df, "b", labels="labels").collect()}
    assert got == {(0, (1, 2), (1, -100), (1, 1)), (0, (3, 0), (3, -100), (1, 0)), (1, (), (), ())}
    log = spark.createDataFrame([(1, "x"), (2, "frac in_deck=0.5 y"), (3, "frac in_deck=0.9")], "seq int, value string")
    assert runs.first_metric(log).first().metric == 0.5
    p = spark.createDataFrame([("o/checkpoint-500",), ("o/checkpoint-1500/",), ("o/final",)], "path string")
    assert runs.latest_checkpoint(p).first().step == 1500
