import hashlib

from pyspark.sql import functions as F

from decklake.functions import chat as C
from decklake.functions import stats as S
from decklake.functions import text as T

ODD = ["", " ", "a b\n\nc", "x\r\ny\x0bz", "\x1c lead\x85next ", "\ufeffa", "beam b1\n// note\n  fix n1", "é m² 😀 tail\n", "//\nq,r s", "　wide　 k", None]


def kinds(t):
    return [line.strip().split()[0] for line in t.splitlines() if line.strip() and not line.strip().startswith("//")]


def test_lines_strip_and_kinds_follow_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    rows = df.select("i", T.strip("t").alias("s"), T.lines("t").alias("l"), T.raw_lines("t").alias("r"), T.kinds("t").alias("k"), T.signature("t").alias("sig"), T.signature_fine("t").alias("fine")).collect()
    for r in rows:
        t = ODD[r.i]
        if t is None:
            assert r.s is None
            continue
        assert r.s == t.strip()
        assert r.l == t.splitlines() and r.r == t.splitlines(keepends=True)
        assert r.k == kinds(t)
        assert r.sig == ",".join(sorted(set(kinds(t)))) and r.fine == ",".join(kinds(t))


def test_hash_and_bucket(spark):
    df = spark.createDataFrame([("abc",), ("ñ",)], "t string")
    got = df.select("t", T.hash32("t").alias("h"), T.bucket("t").alias("b")).collect()
    for r in got:
        h = int(hashlib.sha1(r.t.encode()).hexdigest()[:8], 16)
        assert (r.h, r.b) == (h, h % 100)
    assert got[0].h == 2845392438


def test_deck_extraction_variants_disagree_as_they_should(spark):
    x = "A<think>x</think>B</think> C\nsolve s\nD"
    r = spark.createDataFrame([(x,)], "x string").select(T.without_scratchpad("x"), T.after_last_close("x"), T.after_first_close("x"), T.until_solve("x"), T.close_offset("x")).first()
    assert tuple(r) == ("AB</think> C\nsolve s\nD", "C\nsolve s\nD", "B</think> C\nsolve s\nD", "B</think> C\nsolve s", 17)


def test_without_marks_the_whole_text_is_the_deck(spark):
    r = spark.createDataFrame([(" a\nb ",)], "x string").select(T.without_scratchpad("x"), T.after_last_close("x"), T.after_first_close("x"), T.until_solve("x"), T.close_offset("x")).first()
    assert tuple(r) == ("a\nb", "a\nb", " a\nb ", "a\nb", 0)


def test_first_difference_and_basename(spark):
    df = spark.createDataFrame([("abc", "abd", "x/y/"), ("ab", "abc", "z"), ("", "", "a/b")], "a string, b string, p string")
    assert [tuple(r) for r in df.select(T.first_difference("a", "b"), T.basename("p")).collect()] == [(2, "y"), (2, "z"), (0, "b")]


def test_messages(spark):
    m = [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"), ("user", "u3")]
    df = spark.createDataFrame([(m,), ([],)], "m array<struct<role string, content string>>")
    a, b = df.select(C.last_assistant("m"), C.first_assistant("m"), C.first_user("m"), F.size(C.context("m")), C.rendered("m", "|", True), C.training_text("m", "|")).collect()
    assert tuple(a)[:4] == ("a2", "a1", "u1", 4)
    assert a[4] == "<|user|>\nu1\n<|assistant|>\na1|<|user|>\nu2\n<|assistant|>\na2|<|user|>\nu3\n<|assistant|>\n"
    assert a[5] == "<|user|>\nu1\n<|assistant|>\na1|<|user|>\nu2\n<|assistant|>\na2|"
    assert tuple(b)[:3] == (None, None, None) and b[4] == "<|assistant|>\n"


def test_wilson(spark):
    low, high = S.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(3, 10), (0, 0), (5, 5)], "h long, n long").select(low, high).collect()
    assert tuple(got[0]) == (0.10778928748621183, 0.6032267800204347) and tuple(got[1]) == (0.0, 0.0) and got[2][1] == 1.0
