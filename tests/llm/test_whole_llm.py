"""The training-data operators do the whole job: what a smaller one would leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.llm import attention, jaccard, quality, scoring, secrets

P = pytest.importorskip("public_tokenizers")


def test_each_training_document_is_learnt_from_once(spark):
    body = spark.range(300).select(F.xxhash64("id").alias("row"), (F.col("id") % 7 != 2).cast("int").alias("flag"))
    rounds = [{r.row for r in body.where(scoring.learnt_in(k)).collect()} for k in range(scoring.ROUNDS)]
    want = {r.row for r in body.where("flag = 1").collect()}
    assert set().union(*rounds) == want and sum(map(len, rounds)) == len(want)


def test_a_few_documents_are_learnt_from(spark):
    docs = spark.createDataFrame([(k, "la le li lo " * 400) for k in range(12)], "doc_id long, text string").coalesce(2)
    rows = scoring.score(docs, P.path("byte_bpe_50k.json")).collect()
    assert min(r.score / r.n_tokens for r in rows) > -1.0


def test_the_model_has_its_first_size():
    assert attention.D >= 16 and attention.CLASSES >= 96 and attention.WINDOW >= 64 and 2 * attention.CONTEXT >= attention.WINDOW


def test_a_token_has_half_a_window_of_context():
    x, t, c = attention.cut(np.arange(500) % attention.CLASSES)
    assert c.sum() == 500 and not c[1:, : attention.WINDOW // 2].any()


def key_lines(n):
    return [("MIIEvQ+/b64" * 6)[k % 11 :][:64].ljust(64, "A") for k in range(n)]


def test_whole_private_keys_go(spark):
    body, begin, end = key_lines(25), "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = [begin, *body, "Zk9=", end]
    long = [begin, *key_lines(6000)]
    texts = {
        1: ("\n".join(["before it", *lines, "after it"]), "before it\n[SECRET]\nafter it"),
        2: ("\r\n".join(["a", *lines, "b."]), "a\r\n[SECRET]\r\nb."),
        3: ("\n".join([begin, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *body, end, "x"]), "[SECRET]\nx"),
        4: ("\n".join([begin, *body, "Zk9=", "", "The end is missing."]), "[SECRET]\n\nThe end is missing."),
        5: ("k: |\n" + "\n".join("  " + x for x in lines) + "\nz: 1", "k: |\n  [SECRET]\nz: 1"),
        6: ('{"key": "' + "\\n".join(lines) + '\\n", "z": 1}', '{"key": "[SECRET]\\n", "z": 1}'),
        7: ("\n".join([*lines, "", *lines, "end"]), "[SECRET]\n\n[SECRET]\nend"),
        8: (f"A line {begin} is the head of a key, and no more.", "A line [SECRET] is the head of a key, and no more."),
        9: ("\n".join([*long, "", "So it ends."]), "[SECRET]\n\nSo it ends."),
        11: ("\n".join([begin, "Version: 7", "Comment: a key, and: more", "X-Any: 1", "", *body, "Zk9=", end, "x"]), "[SECRET]\nx"),
        12: ("\n".join(["-----BEGIN PGP PRIVATE KEY BLOCK-----", "Version: GnuPG v2", "", *body, "=AbC1", "-----END PGP PRIVATE KEY BLOCK-----", "end."]), "[SECRET]\nend."),
        13: ("\n".join([begin, "Note: no key follows here.", "It ends."]), "[SECRET]\nNote: no key follows here.\nIt ends."),
        10: ("-----BEGIN OPENSSH PRIVATE KEY-----\n" + "\n".join(body) + "\n-----END OPENSSH PRIVATE KEY-----", "[SECRET]"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {i: want for i, (_, want) in texts.items()}
    import duckdb

    from decklake.llm.oracles import op5

    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(i, t) for i, (t, _) in texts.items()])
    want = {r[0]: r[-2] for r in db.execute(op5()).fetchall()}
    assert {r.doc_id: r.spans for r in secrets.scan(docs).select("doc_id", secrets.spell(F.col("spans")).alias("spans")).collect()} == want


def test_clean_lines_that_mention_a_phrase_stay(spark):
    prose = "The museum keeps a catalog in the east wing, where a baker once wrote a blog in verse about one cookie, the copyright of a song and the people who subscribe to letters. "
    hindi, arabic = "यह एक साधारण वाक्य है और यहाँ समाप्त होता है।", "هل هذه جملة عادية تنتهي هنا؟"
    keep = [prose.strip(), prose * 20 + "It ends.", "She read the catalog in bed.", hindi, arabic]
    drop = ["Licensed under the MIT License.", "Copyright 2020 Acme. All rights reserved.", "Please sign up or log in.", "Cookies and privacy policy."]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(keep + drop)], "k int, line string")
    assert [r.f for r in frame.select("k", quality.line_fails(F.col("line")).alias("f")).orderBy("k").collect()] == [False] * len(keep) + [True] * len(drop)
    one = quality.judge(spark.createDataFrame([(1, prose.strip())], "doc_id long, text string")).first()
    assert one.kept and one.clean_text == prose.strip()


def test_the_model_does_not_depend_on_the_layout(spark):
    """The same scores from 1 and 64 partitions, and better held out than a bigram of the same ids (-4.47 a word)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path, got = P.path("byte_bpe_50k.json"), []
    for n in (1, 64):
        got.append({r.doc_id: (r.held_out, r.n_tokens, r.score) for r in scoring.score(docs.repartition(n), path).collect()})
    # the model is the same; sums of a batch's products may differ in their last bits
    assert got[0].keys() == got[1].keys() and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * a[1] for a, b in ((got[0][k], got[1][k]) for k in got[0]))
    out = [x for x in got[0].values() if x[0]]
    assert sum(x[2] for x in out) / sum(x[1] for x in out) > -4.47


def test_several_learners_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(scoring, "LEARNER", 3000)
    texts = [("la le li lo " * (5 + k % 9) + "lu", "mi ma mu " * (k % 7)) for k in range(60)]
    rows = [(k, a + b) for k, (a, b) in enumerate(texts)] + [(5, "la le li lo " * 30)] * 6 + [(7, None), (None, "le")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((repr(r.doc_id), r.n_tokens, r.score) for r in scoring.score(docs.repartition(n), P.path("byte_bpe_50k.json")).collect()) for n in (1, 13)]
    assert len(got[0]) == len(rows) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * a[1] for a, b in zip(*got, strict=True))


def test_a_blob_that_two_scans_entered_counts_once(spark):
    from decklake.llm.common import shared_dir

    docs, ledger = spark.createDataFrame([(1, "token = abcdefgh12"), (2, "none")], "doc_id long, text string"), shared_dir(spark)
    first = secrets.scan(docs, ledger).count()
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-copy")
    spark.read.parquet(f"{ledger}-copy").write.mode("append").parquet(ledger)
    assert first == 2 and sorted((r.doc_id, len(r.spans), r.scan) for r in secrets.scan(docs, ledger).collect()) == [(1, 1, 1), (2, 0, 1)]


def test_words_are_encoded_once_and_have_the_ids_of_the_whole_text(monkeypatch):
    texts = ["La le  li\nlo la", "", "a\xa0 \xa0y \x85b z q\x85 \x85r", "k" * 3000 + " la", "'s n't \x1c\x1dfoo 12ab--c €5 ınter", "la \u3042 le", "\x00 \x01", "le lo la " * 50]
    raws = [t.encode().lower() for t in texts]
    whole = scoring.Subwords(P.path("byte_bpe_50k.json"))(raws)
    subwords, seen, fast = scoring.Subwords(P.path("byte_bpe_50k.json")), [], scoring.encoder(P.path("byte_bpe_50k.json")).fast
    monkeypatch.setattr(scoring.encoder(P.path("byte_bpe_50k.json")), "fast", type("Fast", (), {"encode_to_numpy": lambda _, t, **b: (seen.append(t), fast.encode_to_numpy(t, **b))[1]})())
    for _ in range(2):
        assert [x.tolist() for x in subwords.of_words(raws, scoring.Words(raws))] == [x.tolist() for x in whole]
    words = " ".join(seen).split(" ")
    assert [words.count(w) for w in ("lo", "li", "12ab--c")] == [1, 1, 1]
    monkeypatch.setattr(scoring, "MEMO", 3)
    assert [x.tolist() for x in subwords.of_words(raws[::-1], scoring.Words(raws[::-1]))] == [x.tolist() for x in whole[::-1]]


def test_a_step_learns_from_a_whole_batch():
    """Windows that are left over wait for the next text; none is lost."""
    _, _, logs = attention.classes_of(np.arange(3000)[::-1], np.arange(3000) % 2 == 0)
    learner = attention.Learner(attention.initial(logs))
    for _ in range(5):
        learner.add(attention.cut(np.arange(40 * attention.WINDOW) % 7, 0))
    assert learner.n == 5 * 40 // 32 and learner.waiting == 5 * 40 % 32
    learner.flush()
    assert learner.n == 5 * 40 // 32 + 1 and learner.seen == 5 * 40 * attention.WINDOW and learner.waiting == 0


def test_large_logits_do_not_overflow():
    _, _, logs = attention.classes_of(np.arange(3000)[::-1], np.arange(3000) % 2 == 0)
    x, t, c = attention.cut(np.arange(300) * 7 % attention.CLASSES)
    p = attention.unpacked(attention.initial(logs) * 80)
    assert np.isfinite(attention.target_logs(p, x, t)).all() and np.isfinite(attention.gradient(p, x, t, c)).all()
