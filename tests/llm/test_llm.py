"""The training-data operators against brute force, with null, empty, long, tied, repeated and clashing input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.llm import attention, components, jaccard, mixing, packing, quality, recompression, scoring, secrets, sharding, spotsigs, warc
from decklake.llm import shingles as shingles_module
from decklake.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = " ".join(f"w{i % 97}x{i % 13}" for i in range(120))
B = A.replace("w5x5", "changed")
RUN = "of " * 40
TEXTS = [
    (1, A, "s1"), (2, B, "s1"), (3, A.upper(), "s2"), (4, None, None), (5, "", "s2"), (6, RUN + "end", "s1"), (7, "a b " + RUN, "s3"),
    (8, "one two three", "s3"), (9, "one two three", "s3"), (10, " \t\n", "s1"), (11, "start " + " ".join(A.split()[20:60]) + " stop", None),
    (12, "é ü 😀 " * 30, "s2"), (13, A + "\n" + "line.\nline.\n" + "x" * 5000, "s1"), (13, A + "\n" + "line.\nline.\n" + "x" * 5000, "s1"), (None, A, "s2"), (14, " ".join(f"u{i}" for i in range(3000)), "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(i, t, s, 7, f"x{k}", 1, True) for k, (i, t, s) in enumerate(TEXTS)]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, n int, id string, size int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(t):
    return WORD.findall(t or "")


def test_substring_dedup(docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else 10**9, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in recompression.dedup(docs).collect())
    least = defaultdict(lambda: 10**9 + 1)
    key = lambda i: 10**9 if i is None else i
    for i, t, _ in TEXTS:
        w = words(t)
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(least[tuple(w[k : k + 13])], key(i))
    want = []
    for i, t, _ in TEXTS:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < key(i) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((key(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == sorted(want)
    assert recompression.dedup(none).count() == 0


def test_equal_windows_are_revealed_alike():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 6000).astype(np.uint64)
    first, key = recompression.revealed(text, np.array([0, 10, 1000, 1000, 6000]))
    assert len(first) == 0 + 978 + 4988
    seen = {}
    for k, f in zip(key.tolist(), first.tolist(), strict=True):
        assert seen.setdefault(tuple(text[f : f + 13].tolist()), k) == k


def test_long_repeats_have_high_symbols_in_common():
    rng = np.random.default_rng(8)
    passage = rng.integers(1, 2**63, 2000).astype(np.uint64)
    texts = [np.concatenate([rng.integers(1, 2**63, 50 + 7 * k).astype(np.uint64), passage, rng.integers(1, 2**63, 90).astype(np.uint64)]) for k in range(2)]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    _, tall = recompression.rounds(np.concatenate(texts), starts)
    name, begin, end = (np.concatenate([t[k] for t in tall]) for k in range(3))
    assert (end - begin >= recompression.HIGH).all()
    own = [{n: (b - starts[k], e - starts[k]) for n, b, e in zip(name.tolist(), begin.tolist(), end.tolist(), strict=True) if starts[k] <= b < starts[k + 1]} for k in range(2)]
    both = set(own[0]) & set(own[1])
    covered = np.zeros(len(texts[0]), bool)
    for n in both:
        (a, b), (c, d) = own[0][n], own[1][n]
        assert np.array_equal(texts[0][a:b], texts[1][c:d])
        covered[a:b] = True
    assert covered.sum() > 1500 and len(own[0]) and max(e - b for b, e in own[0].values()) == len(texts[0])


def test_words_are_hashed_alike_in_chunks_of_any_size(monkeypatch):
    raws = [(t or "").encode() for _, t, _ in TEXTS] + [b"", b"\xff\xfe a", b"x" * 5000 + b" y"]
    want, starts = shingles_module.word_hashes(raws)
    flat = [w for r in raws for w in r.split()]
    assert len(want) == len(flat) == starts[-1] and starts.tolist() == [0, *np.cumsum([len(r.split()) for r in raws]).tolist()]
    names = {}
    for w, h in zip(flat, want.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(shingles_module, "CHUNK", size)
        assert np.array_equal(shingles_module.word_hashes(raws)[0], want)
    assert shingles_module.word_hashes([])[0].size == 0
    monkeypatch.setattr(shingles_module, "CHUNK", 10)
    assert shingles_module.lists([1, 2, 20, 3, 3, 3, 3, 1], 3) == [(0, 2), (2, 3), (3, 6), (6, 8)] and shingles_module.lists([], 3) == []


def brute_windows(rows):
    """(n_words, n_removed, digest) of each row by its words."""
    key = lambda i: recompression.LAST if i is None else i
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            least[x] = min(least.get(x, 2**63), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < key(i) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((key(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


CLEAN = {
    "all distinct": [(i, " ".join(f"a{i}_{k}" for k in range(30))) for i in range(20)],
    "one row": [(1, "x y z " * 20)],
    "copies only": [(5, " ".join(f"q{k}" for k in range(100))), (3, " ".join(f"q{k}" for k in range(100)))],
    "wordless": [(1, None), (2, ""), (3, " \t")],
}


@pytest.fixture(params=[1, 4, 211])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_substring_dedup_at_any_partitioning(spark, partitions):
    rng = np.random.default_rng(9)
    pool = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(5, 300)))) for _ in range(10)]
    piece = lambda: str(rng.choice(pool)) if rng.random() < 0.6 else " ".join(map(str, rng.integers(0, 10**9, int(rng.integers(1, 60)))))
    mixed = [([i, i, None, 7][i % 4], " ".join(piece() for _ in range(int(rng.integers(1, 6))))) for i in range(120)]
    rows = mixed + mixed[:20] + [(200 + i, "a b " * (9 * i) + "c " + "z " * (40 * i)) for i in range(8)]
    for case in [rows] + (list(CLEAN.values()) if partitions < 211 else [CLEAN["all distinct"]]):
        got = recompression.dedup(spark.createDataFrame(case, "doc_id long, text string").repartition(3)).collect()
        assert sorted((recompression.LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(case)


def test_jaccard_join_of_clean_tables(spark, partitions):
    for case in list(CLEAN.values()) if partitions < 211 else [CLEAN["copies only"]]:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(case, "doc_id long, text string").repartition(3)).collect()}
        assert got == linked(case)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"]
    size = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    order = [*sorted(s for s in size if s is not None), None]
    aims = mixing.targets([size[s] for s in order], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()))
    for s, aim in zip(order, aims, strict=True):
        assert {r.target for r in by[s]} == {aim} and {r.source_size for r in by[s]} == {size[s]}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_taken_words_come_near_the_targets(spark):
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(["w"] * int(n)), [None, "a", "b", "c", "b", "b"][k % 6]) for k, n in enumerate(rng.integers(0, 300, 3000))] + [(9000 + k, "one text for all of these", "b") for k in range(1500)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, passes int, row string").repartition(3)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    # by hand: a, b, c, null weigh 3, 1, 2, 3 and share 150 %; none gets more than twice its size
    weight, want, free, left = {"a": 3, "b": 1, "c": 2, None: 3}, {}, {"a", "b", "c", None}, 1.5 * sum(size.values())
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    mixed = mixing.mix(docs).collect()
    taken = Counter()
    for r in mixed:
        assert r.taken <= 2 * r["size"] and r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in size)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    words_of = Counter()
    for r in again.collect():
        words_of[r.source] += len(words(r.text))
    assert all(abs(words_of[s] - want[s]) <= 2 for s in size)


def test_targets_are_capped_and_reshared():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert mixing.targets([10, 10], [1, 1], 1000) == [20.0, 20.0] and mixing.targets([0, 5], [1, 1], 7.5) == [0.0, 7.5]


def test_fit_reaches_the_budget():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(0, 900, 40))
        counts = rng.integers(1, 9, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 5))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and (lengths * take).sum() <= budget
        assert budget - (lengths * take).sum() <= 3 or budget > total
    assert mixing.fit(np.array([7, 11]), np.array([2, 2]), 18).tolist() == [1, 1]


def test_warc(spark, none):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nx", "small"), (4, "d", "small"), (5, "e", None), (6, "f", ""), (None, "g", "lone"), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_dir(spark)
    warc.write_archive(pages, folder)
    got = sorted((r.id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in warc.read_archive(spark, folder).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        want.append((i or 0, "revisit" if i == 1 else "response", 2 if i == 1 else None, len(b), hashlib.sha1(b).hexdigest(), b))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in rows})
    for r in warc.read_archive(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert len(rest) == n + 4 and rest.endswith(b"\r\n\r\n")
        assert rest[:-4].endswith(bytes(r.payload) if r.record_type == "response" else b"\r\n\r\n")
    empty = shared_dir(spark)
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_archives_raise(spark):
    folder = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    damaged = spark.createDataFrame([(r.digest, b"y") for r in spark.read.parquet(f"{folder}/payloads").collect()], "digest string, payload binary")
    damaged.write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="disagree"):
        warc.read_archive(spark, folder).collect()


def test_sharding(spark, docs, none):
    rows = sharding.place(docs, 5).collect()
    assert len(rows) == len(TEXTS)
    for shard in range(5):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert sharding.place(none, 5).count() == 0
    maps = shared_dir(spark)
    sharding.place(docs, 5, maps=maps).count()
    sharding.place(docs, 6, maps=maps).count()
    old, new = sharding.SlotMap.load(spark, maps, 1), sharding.SlotMap.load(spark, maps)
    assert (old.version, new.n_shards) == (1, 6) and new.version > 2 and old.shards == sharding.SlotMap.dealt(5).shards


def test_shards_are_near_equal_in_bytes(spark):
    rng = np.random.default_rng(11)
    rows = [(int(k), "x" * int(n)) for k, n in enumerate(rng.pareto(1.5, 20_000) * 200 + 1)] + [(30_000 + k, "the same text") for k in range(9000)]
    placed = sharding.place(spark.createDataFrame([(k, t[:40_000]) for k, t in rows], "doc_id long, text string"), 40)
    load = {r.shard: r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) < 0.02 * min(load.values())
    assert {r.map_version for r in placed.select("map_version").distinct().collect()} == {2}


def test_rebalancing_moves_little():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, sharding.N_SLOTS).tolist()
    old = sharding.SlotMap.dealt(40).rebalanced(sizes)
    load = np.bincount(old.shards, sizes)
    assert load.max() - load.min() < 0.01 * load.mean()
    new = old.rebalanced(sizes, 41)
    load = np.bincount(new.shards, sizes)
    assert load.max() < 1.03 * load.mean()
    moved = [k for k in range(len(sizes)) if old.shards[k] != new.shards[k]]
    assert len(moved) < len(sizes) / 25


SECRETS = [
    "password = 'hunter2hunter2' and Token: abc", 'api_key="AAAABBBB" apikey=short', "token=secret: longenough1", "x AKIAABCDEFGHIJKL y AKIA123 z", "é 😀 " + "0123456789abcdef" * 2 + "f tail",
    "SECRET:==aaaaaaaaa", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "", None, "nothing here", "password='" + "ab" * 40 + "' passwd: x.y_z-1234",
]


def base_spans(t):
    out = []
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in rule.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark):
    rows = [*enumerate(SECRETS), (3, SECRETS[3]), (None, SECRETS[0]), (99, SECRETS[0])]
    docs = spark.createDataFrame([(i, t, "c", "b") for i, t in rows], "doc_id long, text string, blob string, spans string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, [(s.start, s.rank, s.end) for s in r.spans if s.rank < 3]) for r in secrets.scan(docs).collect())
    assert got == sorted((-1 if i is None else i, base_spans(t or "")) for i, t in rows)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[6] == clean[7] == "[SECRET]" and clean[9] is None and clean[10] == "nothing here" and "hunter2" not in clean[0]
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.scan(docs.where("false")).count() == 0


def test_many_secrets_in_one_text(spark):
    n = 3000
    text = " ".join(f"é {k:032x}" for k in range(n))
    docs = spark.createDataFrame([(1, text, "b", "s", 1)], "doc_id long, text string, blob string, spans string, scan int")
    row = secrets.scan(docs).first()
    assert [(s.start, s.rank, s.end) for s in row.spans] == base_spans(text) and len(row.spans) == n
    clean = secrets.redact(docs).first()
    assert clean.text == " ".join("é [SECRET]" for _ in range(n)) and (clean.blob, clean.spans, clean.scan) == ("b", "s", 1)


def test_the_ledger_scans_each_blob_once(spark):
    ledger = shared_dir(spark)
    one = spark.createDataFrame([(1, "password=12345678")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "password=12345678"), (2, "password=12345678"), (3, "new")], "doc_id long, text string")
    assert secrets.scan(one, ledger).count() == 1 and secrets.scan(two, ledger).count() == 3
    assert spark.read.parquet(ledger).count() == 2
    assert {r.doc_id: r.scan for r in secrets.scan(two, ledger).collect()} == {1: 1, 2: 1, 3: 2} and spark.read.parquet(ledger).count() == 2
    assert secrets.scan(two, ledger, rule_version=2).count() == 3 and spark.read.parquet(ledger).count() == 4


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, with_ids=True).collect()
    bins, whole = defaultdict(list), defaultdict(Counter)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id][r.start, np.frombuffer(bytes(r.ids), "<u4").tobytes()] += 1
    for used in bins.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t, _ in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert whole[i][a, np.array(ids[a:b], "<u4").tobytes()] >= 1
    assert packing.pack(none, path).count() == 0


def test_subwords_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    from decklake.llm.subwords import Encoder

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok, own = Tokenizer.from_file(P.path(name)), Encoder(P.path(name))
        assert (own.fast is None) == (name != "byte_bpe_50k.json")
        texts = [t or "" for _, t, _ in TEXTS] + ["  a  b \n\n c\t d ", "it's WE'LL 12345 ½ ²", "日本語 テキスト", "naïve\u00a0x \u2028 y", "a" * 3000, " " * 2500 + "x", "\u0301e\u0300 ﬁ ǅ Ⅷ ٣"]
        assert own.size == max(tok.get_vocab().values()) + 1
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 50, 3000):
        counts = dict(Counter(rng.integers(1, 1025, n).tolist()))
        plan = packing.Plan(counts)
        placed, used = Counter(), Counter()
        for size, a, b, base, q, offset in plan.intervals:
            placed[size] += b - a
            assert offset + q * size <= 1024 and (b - a) % q == 0
            for k in range((b - a) // q):
                used[base + k] += q * size
        assert placed == Counter(counts) and all(v <= 1024 for v in used.values()) and len(used) == plan.used
        assert plan.used <= 1 + 1.08 * sum(s * c for s, c in counts.items()) / 1024 or n < 100
    assert packing.Plan({1024: 2, 1000: 1, 24: 1, 512: 3}).used == 5


def fewest_bins(pieces, capacity):
    """By trying all placements."""
    best = len(pieces)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= pieces[k]:
                left = list(rooms)
                left[left.index(r)] -= pieces[k]
                place(k + 1, left)
        place(k + 1, [*rooms, capacity - pieces[k]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


def test_reduction_keeps_the_least_number_of_sequences():
    rng = np.random.default_rng(15)
    fixed = 0
    for _ in range(300):
        capacity = int(rng.integers(6, 30))
        pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.left, plan.next, plan.used, plan.intervals = capacity, dict(Counter(pieces)), {}, 0, []
        fixed += (used := plan._reduce())
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert used + (fewest_bins(rest, capacity) if rest else 0) == fewest_bins(pieces, capacity), (capacity, pieces)
    assert fixed > 500


def shingles(t):
    w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def linked(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_join(docs, none):
    rows = [(i, t) for i, t, _ in TEXTS if i is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs.where("doc_id is not null")).collect()}
    assert got == linked(rows)
    assert jaccard.join(docs).count() == len(TEXTS) and jaccard.join(none).count() == 0
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 in ids and not {2, 3, 9} & ids and {4, 5, 8, 10} <= ids


def test_jaccard_join_of_families(spark):
    rng = np.random.default_rng(5)
    base = [[f"b{f}_{k}" for k in range(60)] for f in range(6)]
    common = [f"c{k}" for k in range(30)]
    rows = []
    for i in range(160):
        w = list(base[i % 6])
        for k in rng.integers(0, 60, int(rng.integers(0, 5))):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w + common * int(rng.integers(0, 2)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == linked(rows)


def test_unions_of_any_size_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(16)
    rows = []
    for i in range(60):
        w = [f"b{i % 4}_{k}" for k in range(40)]
        for k in rng.integers(0, 40, int(rng.integers(0, 3))):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (0, 40, 65_536):
        monkeypatch.setattr(jaccard, "UNION", most)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == linked(rows)


def test_one_row_of_each_component_stays(spark):
    near = A.replace("w7x7", "other")
    rows = [(3, A), (3, A), (3, near), (8, near), (None, A), (None, "lone text of its own here"), (None, "lone text of its own here"), (5, "x y"), (4, None), (4, None), (6, "")]
    docs = spark.createDataFrame([(i, t, k, 1, True, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, mark int, kept int, once boolean, rank string").repartition(3)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    first = [x for x in got if x[1] in (A, near)]
    assert len(first) == 1 and first[0][0] == 3 and got[first[0]] == 1
    assert got[None, "lone text of its own here"] == 1 and got[5, "x y"] == 1 and got[4, None] == 2 and got[6, ""] == 1 and sum(got.values()) == 6


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 90: 90, 95: 90, 100: 90}


def test_quality(docs, none):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = []
    for i, t, _ in TEXTS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)})
        want.append((-1 if i is None else i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    assert got == sorted(want)
    assert quality.judge(none).count() == 0


def test_lines_that_fail_go(spark):
    good = "This is a plain sentence of some words that ends as it should.\n" * 1
    text = "".join(f"Sentence {k} is number {k} and has end {k} of its own.\n" for k in range(6)) + "Home | News | About | Contact\nLicensed under the MIT License.\nno end here"
    junk = "\n".join("BUY!! NOW!! CHEAP!! THINGS!! HERE!! TODAY!! ONLY!! " + str(k) for k in range(9))
    a, b, _ = quality.judge(spark.createDataFrame([(1, text), (2, junk), (3, good)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert a.kept and a.clean_text.count("\n") == 5 and "MIT" not in a.clean_text and "Home" not in a.clean_text
    assert not b.kept and not b.base_failed


def sigs_by_hand(text):
    """Signatures by their definition: a common word with the two content words that follow it."""
    import xxhash

    found, w = set(), re.findall(r"\w+", text.lower())
    for k, anchor in enumerate(w):
        if anchor in spotsigs.ANCHORS:
            chain = [x for x in w[k + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add(xxhash.xxh32(f"{anchor} {chain[0]} {chain[1]}").intdigest())
    return found or {xxhash.xxh32("\0" + text).intdigest()}


def fingerprints_by_hand(spark, rows):
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (0, -r[0], hashed[r[1] or ""]) if r[0] is not None else (1, 0, hashed[r[1] or ""]))
    want = Counter()
    spell = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    like = lambda x, y: round(len(x & y) / len(x | y), 9)
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        sa, sb, se = sigs_by_hand(a), sigs_by_hand(b), sigs_by_hand(e)
        want[i, len(a), hashlib.sha256(e.encode()).hexdigest(), spell(sa), spell(se), like(sa, se), like(sa, sb)] += 1
    return want


def fingerprints_of(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.digest(df).collect())


def test_fingerprints(spark, docs, none):
    assert fingerprints_of(docs) == fingerprints_by_hand(spark, [(i, t) for i, t, _ in TEXTS])
    assert spotsigs.digest(none).count() == 0


def test_fingerprints_of_large_ids_nulls_and_repeats(spark):
    text = lambda k: " ".join(f"the {'abcdef'[(k * j) % 6]}{j % 7} of b{j % (k + 2)}" for j in range(30))
    for ids in ([2**60 + k for k in range(1, 12)], [-(2**63), None, None, 2**63 - 1, 0, -5], [None] * 5, [7] * 40 + [1, 2, 9], list(range(200)), [3]):
        rows = [(i, text(k % 9)) for k, i in enumerate(ids)]
        assert fingerprints_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == fingerprints_by_hand(spark, rows)


def test_rows_of_one_id_spread_over_ranges():
    rng = np.random.default_rng(17)
    place = np.append(np.full(600, 50), rng.integers(0, 100, 400))
    hashed = rng.integers(-(2**63), 2**63 - 1, 1000)
    often = [50] * 6 + [20, 80, 90]
    cuts = np.sort(np.array(often)), np.array([-(2**63)] + [-(2**63) + j * 2**64 // 6 for j in range(6)] + [-(2**63)] * 2, np.int64)
    got = spotsigs._range(place, hashed, cuts)
    assert got.tolist() == [sum((a, b) <= (p, h) for a, b in zip(*cuts, strict=True)) for p, h in zip(place.tolist(), hashed.tolist(), strict=True)]
    assert np.bincount(got, minlength=10)[2:7].min() > 50


def test_near_pairs(spark):
    rows = [(i, " ".join(f"the w{i // 4}_{k} v{i // 4}_{k}" for k in range(40) if (i + k) % 9 or i % 4 == 0)) for i in range(24)] + [(30, None), (31, ""), (32, "the w0_1 v0_1")]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.7)
    cls = {r.doc_id: r["class"] for r in members.collect()}
    sets = {i: spotsigs.signatures(t or "") for i, t in rows}
    want = {(a, b) for a in set(cls.values()) for b in set(cls.values()) if a < b and spotsigs.likeness(sets[a], sets[b]) >= 0.7}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert cls[31] == 30


def test_scoring(docs, none):
    import math

    rows = scoring.score(docs, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(TEXTS)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    c = Counter(x for i, t, _ in TEXTS if not out(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, out(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in TEXTS)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert scoring.score(none, P.path("byte_bpe_50k.json")).count() == 0


def plain_logs(p, classes):
    """Log probability of each class by loops over positions: the window that counts it, attention to what is before it, two softmaxes."""
    A, out = attention, []
    step, n = A.WINDOW - A.CONTEXT, len(classes)
    seq = [A.BOS, *classes.tolist()]
    for i in range(n):
        start = 0 if i < A.WINDOW else -(-(i - A.WINDOW + 1) // step) * step
        x = [p["E"][seq[j]] + p["P"][j - start] for j in range(start, i + 1)]
        q = x[-1] @ p["Q"]
        w = np.array([np.exp(np.clip(q @ (v @ p["K"]) / np.sqrt(A.D), -30, 30)) for v in x])
        y = sum(a * (v @ p["V"]) for a, v in zip(w / w.sum(), x, strict=True))
        h = x[-1] + y @ p["O"]
        group, place = divmod(int(classes[i]), A.MEMBERS)
        one, two = h @ p["G"] + p["g"], h @ p["U"][group] + p["b"][group]
        out.append(one[group] - np.log(np.exp(one).sum()) + two[place] - np.log(np.exp(two).sum()))
    return np.array(out)


def test_scores_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(13)
    texts = {k: " ".join(rng.choice(["la", "mere", "of", "tokens", "x", "Zürich"], int(rng.integers(0, 90)))) for k in range(14)}
    docs = spark.createDataFrame([*texts.items(), (20, None)], "doc_id long, text string").repartition(3)
    path = P.path("byte_bpe_50k.json")
    fitted = scoring.fit(docs, path)
    got = {r.doc_id: r.score for r in scoring.score(docs, path, fitted=fitted).collect()}
    subwords, p = scoring.Subwords(path), attention.unpacked(fitted.flat.astype(np.float64))
    for k, t in {**texts, 20: ""}.items():
        ids = subwords([t.encode().lower()])[0]
        want = (plain_logs(p, fitted.of[ids]).sum() + fitted.shares[ids].sum()) / np.log(10)
        assert got[k] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_the_model_beats_counts_of_its_own_ids(spark):
    rng = np.random.default_rng(14)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ster", "an", "vu"], int(rng.integers(2, 5)))) for _ in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary, 300))) for k in range(300)], "doc_id long, text string").repartition(2)
    path = P.path("byte_bpe_50k.json")
    fitted = scoring.fit(docs, path)
    subwords = scoring.Subwords(path)
    rows = scoring.score(docs, path, fitted=fitted).join(docs, "doc_id").where("held_out").collect()
    train = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = np.bincount(np.concatenate(subwords([t.encode() for t in train])), minlength=subwords.encoder.size) + 1
    logs = np.log10(counts / counts.sum())
    unigram = sum(logs[ids].sum() for ids in subwords([r.text.encode() for r in rows]))
    assert len(rows) > 20 and sum(r.score for r in rows) > 0.8 * unigram


def test_attention_is_causal_and_scores_each_token_once():
    counts, begins = np.arange(3000)[::-1], np.arange(3000) % 2 == 0
    of, shares, logs = attention.classes_of(counts, begins)
    assert all(abs(np.exp(shares[of == c]).sum() - 1) < 1e-9 for c in np.unique(of))
    p = attention.unpacked(attention.initial(logs))
    rng = np.random.default_rng(6)
    for context in (0, attention.CONTEXT):
        for n in (1, 5, 31, 32, 33, 56, 57, 64, 65, 200):
            seq = of[rng.integers(0, 3000, n)]
            x, t, c = attention.cut(seq, context)
            assert c.sum() == n and np.array_equal(t[c], seq)
    seq = of[rng.integers(0, 3000, 20)]
    x, t, c = attention.cut(seq)
    a = attention.target_logs(p, x, t)
    y = x.copy()
    y[0, 12:] = 3
    b = attention.target_logs(p, y, t)
    assert np.allclose(a[0, :12], b[0, :12]) and not np.allclose(a[0, 12:20], b[0, 12:20])
    assert np.allclose(a[c], plain_logs(p, seq), atol=1e-4)
    every = attention.class_logs(p, np.repeat(attention._attended(p, x)[-1][:1], attention.CLASSES, 0), np.arange(attention.CLASSES))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    large = attention.unpacked(attention.initial(logs) * 80)
    assert (attention.target_logs(large, x, t) <= 0).all()


def test_gradients_and_learning():
    _, _, logs = attention.classes_of(np.arange(3000)[::-1], np.arange(3000) % 2 == 0)
    flat = attention.initial(logs).astype(np.float64)
    rng = np.random.default_rng(7)
    x, t, c = attention.cut(rng.integers(0, attention.CLASSES, 40))

    def nll(f):
        p = attention.unpacked(f)
        return -(attention.class_logs(p, attention._attended(p, x)[-1], t.ravel()) * c.ravel()).sum() / c.sum()

    g = attention.gradient(attention.unpacked(flat), x, t, c)
    places, at = [], 0
    for k in attention.SHAPES:  # some of each kind of parameter, those that matter most
        own = np.abs(g[at : at + attention.SIZES[k]])
        places += (at + np.argsort(-own)[:6]).tolist()
        at += attention.SIZES[k]
    for k in places:
        d = np.zeros_like(flat)
        d[k] = 1e-5
        assert abs((nll(flat + d) - nll(flat - d)) / 2e-5 - g[k]) < 1e-4
    learner = attention.Learner(attention.initial(logs))
    seq = np.tile([1, 2, 3, 4], 400)
    for _ in range(60):
        learner.add(attention.cut(seq))
    learner.flush()
    x, t, c = attention.cut(seq)
    assert attention.target_logs(attention.unpacked(learner.flat), x, t)[c].mean() > -0.5
