"""The pipeline's stages, each by brute force on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from decklake.llm import mixing, quality, secrets

P = pytest.importorskip("public_tokenizers")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def line_fails(line):
    end = line.rstrip(SPACES)[-1:]
    n = len(line)
    count = lambda chars: sum(line.count(c) for c in chars)
    if end not in quality.END_MARKS and not re.search(r"[.!?][\x20\x09-\x0D]", line):
        return True
    if 10 * count(quality.SYMBOLS) > n or count(quality.SEPARATORS) >= 2 or 12 * line.count("!") > n:
        return True
    said = sum(len(m) for m in re.findall(quality.PHRASE, line.lower()))
    return n <= 200 and 4 * said >= n


def cleaned(text):
    """The text without its failing lines, or None where the document goes."""
    text, w = text or "", words(text)
    lines = text.split("\n")
    bad = [bool(words(x)) and line_fails(x) for x in lines]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    lost = sum(len(x) for x, b in zip(lines, bad, strict=True) if b)
    if len(w) < 20 or 100 * len(repeated) > 30 * len(w) or 100 * lost > 50 * len(text):
        return None
    return "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def first_of_each(rows):
    """Of each component of linked rows that with the least id."""
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        if find(k) not in best or order < best[find(k)][0]:
            best[find(k)] = (order, r)
    return [r for _, r in best.values()]


def redacted(text):
    spans = []
    for _, pattern, group, least in secrets.BASE:
        spans += [m.span() for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for _, pattern, _ in secrets.ADDED:
        spans += [m.span() for m in re.finditer(pattern.replace("(?m:$)", "(?=\n|\\Z)"), text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def some_documents():
    rng = random.Random(8)
    stock = [f"w{k}" for k in range(400)]
    said = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    rows = []
    for k in range(70):
        lines = [f"{said(rng.randrange(8, 40)).capitalize()}." for _ in range(rng.randrange(2, 7))]
        if k % 6 == 0:
            lines.insert(1, "Home | News | Shop | About")
        if k % 7 == 0:
            lines.append(f"The token = {'abcd1234' * (1 + k % 3)} opens it.")
        if k % 10 == 0:
            lines.append("Its key is AKIA" + "Q7" * 9 + " and its sum " + "0a1b" * 10 + ".")
        rows.append({"doc_id": k, "text": "\n".join(lines), "source": [None, "a", "b", "b", "b"][k % 5]})
    for k in range(12):  # near and exact copies
        t = rows[5 * k]["text"]
        rows.append({"doc_id": 100 + k, "text": t if k % 2 else t + "\nOne more line at the end.", "source": "b"})
    rows += [{"doc_id": 200, "text": None, "source": "a"}, {"doc_id": 201, "text": "", "source": "a"}, {"doc_id": 202, "text": "Too short.", "source": None}]
    rows += [{"doc_id": 203, "text": "again and again it says the same old words " * 40 + ".", "source": "a"}]
    rows += [{"doc_id": 204, "text": "\n".join(["no end of a sentence here at all", "nor in this line of words"] * 9), "source": "a"}]
    rows += [{"doc_id": None, "text": f"{said(50)}.", "source": "b"}, {"doc_id": 30, "text": rows[30]["text"], "source": rows[30]["source"]}]
    return rows


def test_stages_by_hand(spark, tmp_path):
    rows = [{**r, "lang": "en", "n_chars": len(r["text"] or ""), "row": "kept", "blob": 5, "passes": 6} for r in some_documents()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, blob int, passes int"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    got = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == schema.replace(",", "").split()[::2], name
        got.append([r.asDict() for r in docs.collect()])
        assert all(r["n_chars"] == len(r["text"]) and (r["row"], r["blob"], r["passes"], r["lang"]) == ("kept", 5, 6, "en") for r in got[-1])
    clean = [{**r, "text": t} for r in rows if (t := cleaned(r["text"])) is not None]
    assert Counter(map(key, got[0])) == Counter(map(key, clean)) and 70 < len(clean) < len(rows)
    once = first_of_each(got[0])
    assert Counter(map(key, got[1])) == Counter(map(key, once)) and len(once) <= len(clean) - 10
    hidden = [{**r, "text": redacted(r["text"])} for r in got[1]]
    assert Counter(map(key, got[2])) == Counter(map(key, hidden)) and sum("[SECRET]" in r["text"] for r in hidden) >= 10
    # the mix: rows come whole, up to twice, and each source's words come near its target
    size = Counter()
    for r in got[2]:
        size[r["source"]] += len(words(r["text"]))
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    aims = mixing.targets([size[s] for s in order], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()))
    taken, times = Counter(), Counter(map(key, got[3]))
    for r in got[3]:
        taken[r["source"]] += len(words(r["text"]))
    assert set(times) <= set(map(key, got[2])) and max(times.values()) <= 2
    shortest = min(len(words(r["text"])) for r in got[2])
    assert all(abs(taken[s] - aim) <= shortest for s, aim in zip(order, aims, strict=True))
    pieces = [r.asDict() for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()]
    by_doc, bins = defaultdict(Counter), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]][r["start"], r["length"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for used in bins.values():
        ends = [o + n for o, n in sorted(used)]
        assert [o for o, _ in sorted(used)] == [0, *ends[:-1]] and ends[-1] <= 1024
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(Counter)
    for r in got[3]:
        n = len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        want[r["doc_id"]].update((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
    assert by_doc == want
    # no more sequences than first fit by falling length needs
    room = []
    for n in sorted((n for c in want.values() for (_, n), k in c.items() for _ in range(k)), reverse=True):
        at = next((i for i, x in enumerate(room) if x >= n), None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    assert len(bins) <= len(room)
