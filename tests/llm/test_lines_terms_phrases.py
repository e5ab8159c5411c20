"""Line dedup, collocations and the source audit against brute force, and their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.llm import collocations, divergence, linededup, shingles
from decklake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"
EMPTY = {"op11_line_dedup": 4, "op12_collocations": 8, "op13_source_audit": 6}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert df.count() == 0 and len(df.columns) == EMPTY[name]


# ---- lines ----


def lines_by_hand(rows):
    """Of each row (lines, dropped, kept text): rows are documents."""
    held = defaultdict(list)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(id)
    gone = {}
    for k, ids in held.items():
        known = [i for i in ids if i is not None]
        if len(k) >= 20 and len(ids) >= 3 and known:
            gone[k] = max(known)
    out = []
    for id, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if key(x) not in gone or id == gone[key(x)]]
        out.append((id, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def some_lines(n, seed):
    rng = random.Random(seed)
    stock = [f"  A line that many Documents have, number {k}.\t" for k in range(12)] + ["short", "", "Überall steht diese Zeile im Text", "x" * 19, "y" * 20]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(stock).upper() if rng.random() < 0.2 else rng.choice([*stock, f"one line of {i} only, and no more"]) for _ in range(rng.randrange(0, 9)))
        rows.append((rng.choice([i, i, i, max(0, i - 1)]) if i % 17 else None, None if i % 13 == 0 else text))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    rows = some_lines(200, 3) + [(77, "a line that a third of all rows hold\nand its end")] * 90 + [(5000, "w" * 200_000 + "\n" + "\n".join(["y" * 20] * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup(docs).collect()]
    assert sorted(got, key=repr) == lines_by_hand(rows)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_lines_and_others_go_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rows = some_lines(60, 5)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == lines_by_hand(rows)


def test_lines_keep_columns_of_any_names(spark):
    line = "the same line in three documents"
    docs = spark.createDataFrame([(k, line, 7, 8, 9, 1, 2) for k in range(3)], "doc_id long, text string, row int, gone int, lines int, h1 int, last int")
    got = linededup.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert {(r.doc_id, r.n_dropped, r.kept_text, r.row, r.gone, r["lines"], r.last) for r in got.collect()} == {(0, 1, "", 7, 8, 9, 2), (1, 1, "", 7, 8, 9, 2), (2, 0, line, 7, 8, 9, 2)}


def test_levels_are_compacted_and_hold_each_line_once(spark):
    runs = linededup.Runs(spark, buckets=3, fan=2)
    want = {}
    for batch in range(7):
        rows = [(k, -k, 1 + k % 3, 1000 - batch) for k in range(batch * 5, batch * 5 + 12)]
        for k, _, n, last in rows:
            want[k] = (want.get(k, (0, last))[0] + n, want.get(k, (0, last))[1])
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n long, last long"))
        assert all(len(level) < 2 for level in runs.levels)
        got = runs.merged().collect()
        assert len(got) == len(want) and {r.h1: (r.n, r.last) for r in got} == want
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    runs.close()


# ---- phrases ----


def phrases_by_hand(rows, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= 10:
            cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)
    gone = {(lang, q) for lang, p in found if len(p) == 3 for q in (p[:2], p[1:]) if (lang, q) in found and 100 * found[lang, p][0] >= 50 * found[lang, q][0]}
    out = []
    for lang in total:
        mine = sorted(((-f[3], -f[0], " ".join(p).encode(), f) for (x, p), f in found.items() if x == lang and (x, p) not in gone))[:top]
        out += [(lang, k, p.decode(), f[0], f[1], f[2], total[lang], f[3]) for k, (_, _, p, f) in enumerate(mine, 1)]
    return sorted(out)


def some_phrases(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "New", "York", "x-y", "🙂"] + [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for k in range(n):
        ws = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in ws)
        rows.append((None if k % 19 == 0 else text, [None, "und", "en", "", "de"][k % 5]))
    return rows


@pytest.mark.parametrize("parts, bits", [(1, 12), (40, 12), (3, 6)])
def test_phrases(spark, parts, bits):
    rows = some_phrases(400, 11) + [("the same text again and again", "en")] * 200 + [("a a a " * 30_000, "de"), ("b" * 300_000 + " c " * 12, "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, least_bits=bits).collect())
    assert got == phrases_by_hand(rows)


def test_first_phrases_of_many(spark, monkeypatch):
    rows = [(" ".join(f"p{a}{b}" for a in range(7)), "en") for b in range(12)] * 10
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert sorted(tuple(r) for r in collocations.mine(docs, top=5).collect()) == phrases_by_hand(rows, 5)
    monkeypatch.setattr(collocations, "HOT", 1)  # no word is hot: all names are joined
    assert sorted(tuple(r) for r in collocations.mine(docs, top=5).collect()) == phrases_by_hand(rows, 5)


def test_another_seed_is_taken_where_names_meet(spark, monkeypatch):
    rows = [("la le la le lu", "en")] * 20 + [("xx", "en")]
    salts, first = [], collocations.first_pass
    monkeypatch.setattr(collocations, "first_pass", lambda bits, salt: salts.append(salt) or first(bits, salt))

    def pass_(safe, bits, salt, ranges):
        """With the first seed a rare word has the name of a frequent one."""

        def run(batches):
            if salt == 0:
                hashes = collocations.hashes_of

                def meeting(data, begin, end, seed):
                    h = hashes(data, begin, end, seed)
                    texts = [data[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
                    return np.where(np.array([t == b"xx" for t in texts], bool), h[texts.index(b"la")], h)

                collocations.hashes_of = meeting
            try:
                yield from second(safe, bits, salt, ranges)(batches)
            finally:
                if salt == 0:
                    collocations.hashes_of = hashes

        return run

    second = collocations.second_pass
    monkeypatch.setattr(collocations, "second_pass", pass_)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == phrases_by_hand(rows)
    assert salts == [0, 1]


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**13 - 7, 10**13 - 3, 10**13 - 1)], "a long, l long, r long")
    want = 1_000_000 * (10**13 - 7) ** 2 // ((10**13 - 3) * (10**13 - 1))
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s == want


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal_and_checks_its_keys(n):
    rng = np.random.default_rng(n)
    w = [rng.integers(1, 50, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64), np.zeros(n, np.uint64)]
    w = collocations.distinct_rows(w)
    h = collocations.PerfectHash.of(w)
    h = collocations.PerfectHash.unpack(*h.pack())
    assert sorted(h.slots(w).tolist()) == list(range(len(w[0])))
    counts = rng.integers(1, 9, len(w[0]))
    t = collocations.Table.of([np.concatenate([x, x]) for x in w], np.concatenate([counts, counts]))
    assert (t.read(w) == 2 * counts).all()
    other = [w[0], w[1] + np.uint64(1), w[2]]
    known = set(zip(w[0].tolist(), w[1].tolist(), strict=True))
    assert all(c == 0 or k in known for c, k in zip(t.read(other).tolist(), zip(other[0].tolist(), other[1].tolist(), strict=True), strict=True))


def test_structured_words_have_names_of_their_own():
    morse = bytes(97 + bin(i).count("1") % 2 for i in range(1024))
    base = [morse, bytes(195 - c for c in morse), b"", b"\0", b"\0\0"]
    base += [bytes(p) * k for k in range(1, 60) for p in itertools.product(b"ab", repeat=3)]
    base += [b"a" * k for k in range(1, 700)] + [bytes([c]) + b"x" * 8 * k for c in range(256) for k in (1, 2, 40)]
    texts = sorted(set(base))
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    for seed in (0, 1, 2**64 - 1):
        assert len(set(shingles.hashes_of(data, begin, end, seed).tolist())) == len(texts)


# ---- terms ----


def audit_by_hand(rows, top=200):
    used, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(text or ""))
        used[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        n = {s: sum(used[lang, s][t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))  # noqa: B023, E731
        p = {s: {t: share(used[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(used[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if used[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def some_terms(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)] + ["The", "É", "é", "漢字", "a1b"]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "-", "1"]).join(rng.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(0, 40)))
        rows.append((None if k % 23 == 0 else text, ["en", "de", None, ""][k % 4], [None, "", "s1", "s2", "ñ", "s3"][rng.randrange(6)]))
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_source_audit(spark, parts):
    rows = some_terms(300, 7) + [("one hot text of a third of all rows", "en", "s1")] * 150
    rows += [("x" * 100_000 + " the " * 20_000, "en", "long"), ("lonely words here", "xx", "only"), ("", "yy", "a"), ("rare", "yy", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(parts)
    docs = docs.withColumns({c: F.lit(1) for c in ("place", "term", "n", "used", "p", "q", "size", "item")})
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows)


def test_terms_of_a_report_are_cut(spark):
    rows = some_terms(200, 9)
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), top=4)
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, 4)


def test_shares_pass_64_bits(spark):
    df = spark.createDataFrame([(10**17, 3 * 10**17, 10**9)], "c long, total long, v long")
    assert df.select(divergence.share(F.col("c"), F.col("total"), F.col("v")).alias("p")).first().p == 1 + 10**9 * (10**17 + 1) // (3 * 10**17 + 10**9)
