"""Words with patterns (periods, powers, complements) are told apart where texts are compared."""

import hashlib

import pytest

from decklake.llm import jaccard, recompression


def morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


PATTERNS = [f(n) for n in (64, 1024, 2048) for f in (morse, lambda n: morse(n, True), lambda n: "ab" * (n // 2), lambda n: "ba" * (n // 2), lambda n: "a" * n, lambda n: "aab" * (n // 3))]


def test_windows_of_patterned_words(spark):
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(i, f"{p} {tail}") for i, p in enumerate(PATTERNS)] + [(100, f"{PATTERNS[0]} {tail}"), (101, " ".join(PATTERNS * 2)), (102, " ".join(PATTERNS))]
    first, want = {}, {}
    split = {i: t.split() for i, t in rows}
    for i, w in sorted(split.items()):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(1 for n in want.values() if n[1]) == 2


@pytest.mark.parametrize("words", [1, 5])
def test_sets_of_patterned_words(spark, words):
    rows = [(i, " ".join([p] + [f"v{k}" for k in range(words - 1)])) for i, p in enumerate(PATTERNS)] * 2
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, i) for i in range(len(PATTERNS))}
