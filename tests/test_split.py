import pytest
from pyspark.sql import functions as F

from decklake.functions import text as T
from decklake.operators import sampling, split, tail


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, "\n".join(f"{'abcdefgh'[(i * k) % 8]} n{i % 50}" for k in range(1, 1 + i % 5))) for i in range(400)] + [(400, "mono x"), (401, "mono x"), (402, "")]
    decks = spark.createDataFrame(rows, "seq long, deck string")
    return split.assigned(split.signed(split.deduplicated(decks))).persist()


def test_split_is_a_partition_without_leaks(parts):
    assert parts.count() == parts.select("deck").distinct().count()
    r = split.audit(parts).first()
    assert r.clean and r.kinds_lost == r.coarse_b == r.exact_a == 0
    assert split.checked(parts) is parts


def test_first_copy_stays_and_protected_signatures_are_not_held_out(parts):
    assert parts.where("deck = 'mono x'").first().seq == 400
    assert parts.where("deck = 'mono x'").first().split != "test_b"
    b = {r.sig for r in parts.where("split = 'test_b'").select("sig").distinct().collect()}
    assert len(b) == 8


def test_audit_raises_on_a_leak(parts):
    bad = parts.unionByName(parts.where("split = 'test_b'").withColumn("split", F.lit("train")))
    with pytest.raises(AssertionError):
        split.checked(bad)


def test_comma_kinds_and_empty_decks(spark):
    s = split.signed(spark.createDataFrame([(0, ""), (1, "a,b x")], "seq long, deck string"))
    assert {(r.kind, r.n_sigs) for r in split.kind_spread(s).collect()} == {("", 1), ("a", 1), ("b", 1)}
    assert T.kinds_in("sig") is not None


def test_tail_metrics(spark):
    pairs = spark.createDataFrame([(["a", "b"], ["a", "ghost"]), (["a"], []), ([], ["b"])], "gold array<string>, pred array<string>")
    found = {r.kind: (r.gold, r.pred, r.hit) for r in tail.hits(pairs).collect()}
    assert found == {"a": (2, 1, 1), "b": (1, 1, 0), "ghost": (0, 1, 0)}
    assert [tuple(r) for r in tail.hallucinated(tail.hits(pairs)).collect()] == [("ghost", 1)]
    parts = tail.partitioned(tail.document_frequency(pairs.select(F.col("gold").alias("kinds"))), 2)
    assert [r.kind for r in tail.report(tail.hits(pairs), parts).collect()] == ["b", "a"]


def test_sampling(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).alias("t"))
    assert [r.seq for r in sampling.stratified(df, "t", 3).collect()] == [*range(0, 100, 10), 1, 2, 3]
    a, b = ([r.seq for r in sampling.shuffled(df, s).collect()] for s in (1, 1))
    assert a == b != list(range(100)) and sorted(a) == list(range(100))
    assert a != [r.seq for r in sampling.shuffled(df, 2).collect()]
    assert sampling.resumed(df, df.where("seq < 60")).count() == 40
