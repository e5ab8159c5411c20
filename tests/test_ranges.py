"""Places and sums by ranges, files in output order, features in the row, strict scans, shared documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from decklake.functions import arrays, pairs
from decklake.operators import features, ordering, sampling
from decklake.sources import records, sinks
from decklake.sources.storage import shared_dir


def test_places_and_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50), rng.choice([None, 1, 2**40, -5]), rng.random(), 9) for k in range(3000)]
    df = spark.createDataFrame(rows, "seq long, ts int, v long, x double, at int").repartition(13)
    got = ordering.running(df, ["ts", "seq"], {"v_sum": "v", "x_sum": "x"}).collect()
    n, v, x = 0, 0, 0.0
    assert len(got) == len(rows)
    for r, want in zip(sorted(got, key=lambda r: r.idx), sorted(rows, key=lambda r: (r[1], r[0])), strict=True):
        n, v, x = n + 1, v + (want[2] or 0), x + want[3]
        assert (r.idx, r.seq, r.ts, r.v, r.v_sum, r["at"]) == (n, want[0], want[1], want[2], v, 9) and abs(r.x_sum - x) < 1e-6


def test_places_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, v int")
    assert ordering.running(none, ["seq"], {"s": "v"}).collect() == []
    assert ordering.ranked(none, "v", ["seq"], "rank").collect() == []
    assert sampling.remaining(none, "v", ["seq"]).collect() == []


def test_no_task_sees_a_whole_log(spark):
    log = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("ok"))
    out = sampling.running(log, "ok", ["seq"])
    assert {(r.idx, r.so_far) for r in out.collect()} == {(k + 1, (k + 1) // 2) for k in range(1000)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the only window is over a row for each range, not over the log
    assert plan.count("Window [") == 1 and plan.index("Window [") < plan.index("Aggregate [") < plan.rindex("Relation [")


def test_ranks_in_groups(spark):
    rows = [(g, k) for g in ("a", "b", None) for k in range(500)]
    random.Random(2).shuffle(rows)
    got = ordering.ranked(spark.createDataFrame(rows, "g string, k long").repartition(7), "g", [F.desc("k")], "rank")
    assert {(r.g, r.k, r["rank"]) for r in got.collect()} == {(g, k, 500 - k) for g, k in rows}


def test_files_come_in_order(spark, tmp_path):
    rows = [(s, k % 7, k, f"ñ {k}", None) for k in range(900) for s in ("train", "val")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "split string, rank int, seq long, text string, none string").repartition(5)
    sinks.write_ordered(df, str(tmp_path), ["rank", "seq"], columns=["text", "none"])
    for s in ("train", "val"):
        lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / f"split={s}").glob("part-*"))).split("\n")[:-1]
        want = [{"text": r[3], "none": None} for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))]
        assert [json.loads(x) for x in lines] == want


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_sums_before(spark, n):
    values = [None if k % 11 == 3 else (k * 37) % 1000 for k in range(n)]
    df = spark.createDataFrame([(values,), (None,)], "v array<int>")
    want, total = [], 0
    for v in values:
        want.append(total)
        total += v or 0
    assert [r.s for r in df.select(arrays.sums_before(F.col("v")).alias("s")).collect()] == [want, None]


def test_label_masks(spark):
    rows = [([5, 6, 7, 8], [0, 2, 2, 9], p) for p in (0, 1, 2, 3, 9, 10)] + [([], [], 4)]
    df = spark.createDataFrame(rows, "ids array<bigint>, starts array<bigint>, p int")
    got = [r.m for r in df.select(features.label_mask(F.col("ids"), F.col("starts"), F.col("p")).alias("m")).collect()]
    assert got == [[i if s >= p else -100 for i, s in zip(ids, starts, strict=True)] for ids, starts, p in rows]


def test_features_do_not_move_rows(spark, sf):
    from decklake.plans import catalog

    for name in ("label_mask", "truncated_ids"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


def test_padding_keeps_columns_of_any_names(spark):
    df = spark.createDataFrame([(0, [1], 5), (0, [1, 2], 6)], "b int, ids array<bigint>, longest int")
    assert {(tuple(r.ids), r.longest) for r in features.padded(df, "b").collect()} == {((1, 0), 5), ((1, 2), 6)}


def test_strict_scan_names_the_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "1"}\n{"instruction": "2"}\n')
    (tmp_path / "b.jsonl").write_text('{"instruction": "3"}\n\n{"instr\n"x"\n\u2003\n{"output": 4}\n', encoding="utf-8")
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    good, broken = records.scan_strictly(spark, a, b)
    assert [(r.file_no, r.line_no, r.instruction, r.output) for r in good.orderBy("file_no", "line_no").collect()] == [(0, 0, "1", None), (0, 1, "2", None), (1, 0, "3", None), (1, 5, None, "4")]
    found = [(r.path, r.line_no, r.why.split()[0]) for r in broken.orderBy("line_no").collect()]
    assert found == [(b, 1, "blank"), (b, 2, "not"), (b, 3, "not"), (b, 4, "blank")]
    with pytest.raises(ValueError, match=r"b\.jsonl, line 2: blank line"):
        records.read_strictly(spark, a, b)
    assert records.read_strictly(spark, a).count() == 2


def test_documents_in_the_shared_folder(spark):
    base = shared_dir(spark)
    sinks.write_once({"a": "ñ"}, f"{base}/x/one.json")
    with pytest.raises(FileExistsError):
        sinks.write_once({}, f"{base}/x/one.json")
    assert records.json_document(f"{base}/x/one.json") == {"a": "ñ"}
    with pytest.raises(FileNotFoundError):
        records.json_document(f"{base}/x/two.json")
    cases = spark.createDataFrame([(2, "two\n"), (1, "ein ß\n")], "seq int, block string")
    assert sinks.write_report(cases, f"{base}/cases.md") == 2
    assert [r.value for r in records.physical_lines(spark, f"{base}/cases.md").orderBy("line_no").collect()] == ["# Cases", "", "ein ß", "two"]


def test_merged_json(spark):
    df = spark.createDataFrame([('{"a": {"b": 1, "c": 2}, "d": [1]}', '{"a": {"b": 3}, "d": {"e": null}}'), (None, '{"x": "ñ"}'), ('{"y": 1}', None)], "p string, c string")
    got = [json.loads(r.m) for r in df.select(records.merged_json(F.col("p"), F.col("c")).alias("m")).collect()]
    assert got == [{"a": {"b": 3, "c": 2}, "d": {"e": None}}, {"x": "ñ"}, {"y": 1}]


def test_pairs_of_bytes(spark):
    texts = ["aba ab", "ñ ab", "", None, "a"]
    want = {}
    for t in texts:
        for w in (t or "").split():
            raw = w.encode()
            for a, b in zip(raw, raw[1:], strict=False):
                want[f"{a:02X}", f"{b:02X}"] = want.get((f"{a:02X}", f"{b:02X}"), 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {(r.a, r.b): r.n for r in pairs.pair_counts(pairs.word_counts(df, r"([\p{L}]+)")).collect()} == want
