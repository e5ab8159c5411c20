"""Queries over whole tables: no subset of ids, no prefix of a text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from decklake.plans import catalog
from decklake.plans import fixtures as X


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Orders on both sides of the id 400."""
    d = str(tmp_path_factory.mktemp("few"))
    part = [(1, 5, "SMALL BRUSHED TIN", "Brand#11"), (2, 1, "PROMO BURNISHED TIN", "Brand#22")]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_type string, p_brand string").write.parquet(f"{d}/part.parquet")
    items = [(o, k, 1 + (o + k) % 2, 7, 3.0 + k, 9.0) for o in (1, 399, 400, 401, 9000) for k in range(1, 3 + o % 2)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    return d


TREES = ("typed_tree", "typed_tree_with_family", "fallback_tree", "token_paths", "pair_bias", "newest_row_bias", "whole_bias", "neighbour_prefixes")


@pytest.mark.parametrize("name", TREES)
def test_all_decks_are_in(spark, few, name):
    assert {r.ex for r in catalog.QUERIES[name](spark, few).select("ex").distinct().collect()} == {1, 399, 400, 401, 9000}


def test_pairs_of_all_decks(spark, few):
    ids = {"model": 31, "beam": 5, "weld": 61, "fix": 20, "load": 28, "solve": 49, "//": 0}
    want, counts = set(), {}
    for r in X.known_decks(spark, few).collect():
        assert r.text[r.d0 : r.d1] == r.deck
        paths, stmt = [], 0
        for m in re.finditer(r"\w+|[^\w\s]", r.text[: r.d0]):
            paths.append(None)
        for text in r.deck.split("\n"):
            if not text:
                continue
            stmt += 1
            k, nm, _ = text.split(" ")
            cuts = (len(k), len(k) + 1 + len(nm))
            paths += [(ids.get(k, 62), stmt, sum(m.start() >= c for c in cuts)) for m in re.finditer(r"\w+|[^\w\s]", text)]
        for i, a in enumerate(paths):
            for j, b in enumerate(paths):
                d = 3 - next((n for n in range(3) if a[n] != b[n]), 3) if a and b else 3
                counts[d] = counts.get(d, 0) + 1
                if i <= j:
                    want.add((r.ex, i, j, d, round(-0.5 * d / 3, 9) if i != j and a and b else 0.0))
    rows = catalog.QUERIES["pair_bias"](spark, few).collect()
    assert len(rows) == len(want) and {(r.ex, r.i, r.j, r.d, round(r.bias, 9)) for r in rows} == want
    assert {r.d: r.pairs for r in catalog.QUERIES["distance_counts"](spark, few).collect()} == counts


def test_features_of_whole_texts(spark, tmp_path):
    texts = {1: "ab " * 30 + "cde  f", 2: "x", 3: " ".join("w" * (k % 9) for k in range(20000)), 9: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {k: [len(w) for w in t.split(" ")] for k, t in texts.items()}
    labels = {r.doc_id: r.labels for r in catalog.QUERIES["label_mask"](spark, str(tmp_path)).collect()}
    assert labels == {k: " ".join(str(n if sum(v[:i]) + i >= 60 else -100) for i, n in enumerate(v[:70])) if len(v) < 70 else labels[k] for k, v in ids.items()}
    assert labels[3].split(" ")[100:] == [str(n) for n in ids[3][100:]]
    rows = {r.doc_id: (r.ids, r.ones, r.zeros) for r in catalog.QUERIES["padded_batch"](spark, str(tmp_path)).collect()}
    wide = {1: 20000, 2: 20000, 3: 20000, 9: 1}
    assert rows == {k: (" ".join(map(str, v + [0] * (wide[k] - len(v)))), len(v), wide[k] - len(v)) for k, v in ids.items()}
    cut = {r.doc_id: r.ids for r in catalog.QUERIES["truncated_ids"](spark, str(tmp_path)).collect()}
    assert cut == {k: " ".join(map(str, v[:2048])) for k, v in ids.items()}


def test_all_splits_are_ordered(spark, sf):
    rows = catalog._split(spark, sf).collect()
    first, want = {}, set()
    for r in sorted(rows, key=lambda r: r.seq):
        first.setdefault(r.sig, r.seq)
    for split in ("train", "val", "test_a", "test_b"):
        key = lambda s: (hashlib.sha1(s.encode()).hexdigest()[:8], s) if split == "test_b" else first[s]  # noqa: B023, E731
        rank = {s: k for k, s in enumerate(sorted({r.sig for r in rows if r.split == split}, key=key), 1)}
        want |= {(split, rank[r.sig], r.seq) for r in rows if r.split == split}
    got = catalog.QUERIES["output_order"](spark, sf).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want and {r.split for r in got} == {"train", "val", "test_a", "test_b"}
