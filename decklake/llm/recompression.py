"""Substring dedup by recompression.

Rounds of locally consistent parsing rename each text: maximal runs of a symbol become one symbol, then adjacent pairs
whose halves fall into the left and right part of the alphabet do. Names are hashes of what they stand for, so they are
global without a dictionary: equal substrings get equal interior symbols wherever they stand. A low symbol (of the first
LOW rounds) carries its context, the words that decide it; where those words stand, the symbol stands there too. A WINDOW
of words is revealed by one low symbol whose context lies inside it (the one with the least hash), or by itself. Renaming
goes on until a text is one symbol; a high symbol stands for HIGH words or more.

1. First Spark round: each partition asks about its low symbols (is it in another text?) and its high symbols (which is
   the least id that has it?). A window that no shared symbol reveals is in one text only. A shared high symbol, which is
   told from others by its name and by a second hash of all its words, settles every window inside it at once in all
   texts but that with the least id.
2. Second Spark round: windows that shared symbols reveal and no high symbol has settled are asked about, by two
   independent 64-bit hashes of their words; again the least id is answered.
3. Words that settled or answered windows cover go, if the least id is smaller than the text's own; the rest is joined.

Exact: the text with the least id that has a window asks about it itself, for a high symbol around it can only be answered
with that same id. Equality of windows is equality of two independent 64-bit hashes, each made of
the words' own hashes by a seed of its own.

Rows: questions and answers are packed (see exchange.py), so a passage in a third of all texts costs one entry a
partition. A task holds its partition's answers, or the questions of its hash range, about 16 to 24 bytes a symbol or window.

Edge cases: null texts are empty; a null id comes after all others and gives way to them only; rows with the same id
and text get the same result each; rows with one id and different texts do not count as each other's source; texts
shorter than WINDOW keep all; an empty table gives no rows; extra columns are not read; texts of any length are renamed whole, by themselves if
they are very long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import shuffle_partitions, text_of
from .shingles import SECOND, SEED, mixed, windows, word_hashes

#: Fixed value: words in a window.
WINDOW = 13
#: Rounds whose symbols reveal windows; words that a high symbol stands for at least; rounds at most (each leaves about 3/4 of the symbols).
LOW, HIGH, ROUNDS = 2, 4 * WINDOW, 64
LAST = 2**63 - 1  # stands for a null id
FAR = 1 << 40
BATCH = 256
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_C_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _runs(sym: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with each maximal run as one, where the runs begin)."""
    first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
    run = sym[first]
    if len(first) < len(sym):
        length = np.diff(np.append(first, len(sym)))
        many = np.flatnonzero(length > 1)
        run[many] = mixed(run[many] * _A + length[many].astype(np.uint64) * _B + salt) | np.uint64(1)
    return run, first


def _pairs(sym: np.ndarray, real: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right: which symbols are in that part of the alphabet, pair: which are the left half of a pair); no barrier is."""
    right = (mixed(sym + salt) & np.uint64(2)) > 0
    left = ~right & real
    right &= real
    return left, right, np.append(left[:-1] & right[1:], False)


def rounds(hashes: np.ndarray, starts: np.ndarray, high: int = HIGH) -> tuple[list[tuple], list[tuple]]:
    """(low, high): of each of the first LOW rounds the symbols with the begin and end of their contexts; of each round
    the new symbols that stand for `high` words or more with their begin and end. Places are words of all texts put together.

    Between texts stands a barrier without words that equals nothing and whose context has no end."""
    n_texts, n_full = len(starts) - 1, int((np.diff(starts) > 0).sum())
    barrier = starts + np.arange(n_texts + 1)
    sym = np.zeros(len(hashes) + n_texts + 1, np.uint64)
    real = np.ones(len(sym), bool)
    real[barrier] = False
    sym[real] = hashes | np.uint64(1)
    begin, end = np.full(len(sym), -FAR), np.full(len(sym), FAR)
    begin[real] = np.arange(len(hashes))
    end[real] = begin[real] + 1
    at = np.append(np.cumsum(real) - real, len(hashes))  # where each symbol's words begin; they end where the next one's do
    sym[barrier] = np.arange(len(barrier)).astype(np.uint64) * np.uint64(2)
    low, tall = [], []
    for k in range(ROUNDS):
        salt = np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
        run, first = _runs(sym, salt)
        made = np.append(first[1:], len(sym)) - first > 1
        if k < LOW:
            b, e = np.minimum.reduceat(begin, first), np.maximum.reduceat(end, first)
            # that a run ends is decided by the one symbol next to it, not by the run which that belongs to
            b[1:] = np.minimum(b[1:], begin[first[1:] - 1])
            e[:-1] = np.maximum(e[:-1], end[first[1:]])
            begin, end = b, e
        sym, real, at = run, real[first], np.append(at[first], at[-1])
        left, right, pair = _pairs(sym, real, salt)
        second = np.append(False, pair[:-1])
        halves = np.flatnonzero(pair)
        if k < LOW:
            alone_left, alone_right = left & ~pair, right & ~second
            after, prior = np.append(end[1:], FAR), np.append(-FAR, begin[:-1])
            end2 = np.where(alone_left, np.maximum(end, after), end)
            begin2 = np.where(alone_right, np.minimum(begin, prior), begin)
            end2[halves] = np.maximum(end[halves], end[halves + 1])
            begin2[halves] = np.minimum(begin[halves], begin[halves + 1])
        sym = sym.copy()
        sym[halves] = mixed(sym[halves] * _B + sym[halves + 1] * _C + salt) | np.uint64(1)
        made |= pair
        keep = ~second
        sym, real, made, at = sym[keep], real[keep], made[keep], np.append(at[:-1][keep], at[-1])
        if k < LOW:
            begin, end = begin2[keep], end2[keep]
            low.append((sym[real], begin[real], end[real]))
        tall_ = made & real & (at[1:] - at[:-1] >= high)
        if tall_.any():
            tall.append((sym[tall_], at[:-1][tall_], at[1:][tall_]))
        if k >= LOW - 1 and int(real.sum()) == n_full:
            break
    return low, tall


class Sums:
    """Second hashes of any stretch of words, by differences of running sums over the words' second hashes."""

    def __init__(self, hashes: np.ndarray):
        power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(hashes), m, np.uint64))) for m in (_C, _C_INVERSE))
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(hashes + _A) * power[:-1]))

    def __call__(self, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self.sums[e] - self.sums[b]) * self.inverse[b] + (e - b).astype(np.uint64))


def revealed(hashes: np.ndarray, starts: np.ndarray, low: list[tuple] | None = None, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, what reveals it) of each window of each text.

    A symbol is told from others by all words of its context, which are more than it stands for: fewer are shared by chance."""
    low = rounds(hashes, starts)[0] if low is None else low
    sums = sums or Sums(hashes)
    none = np.uint64(2**64 - 1)
    best = np.full(len(hashes) + 1, none)
    for level, (_, begin, end) in enumerate(low, 1):
        fits = end - begin <= WINDOW
        b, e = begin[fits], end[fits]
        h = (sums(b, e) >> np.uint64(4)) | np.uint64((7 - level) << 60)
        for back in range(WINDOW):
            i = b - back
            ok = (i >= 0) & (i + WINDOW >= e)
            np.minimum.at(best, i[ok], h[ok])
    counts = np.maximum(np.diff(starts) - WINDOW + 1, 0)
    at = np.arange(counts.sum()) + np.repeat(starts[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts)
    key = best[at]
    alone = key == none
    key[alone] = sums(at[alone], at[alone] + WINDOW) >> np.uint64(4) | np.uint64(7 << 60)
    return at, mixed(key)


def _twice(values: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [np.maximum(np.maximum.reduceat(values[0], begins), (sizes > 1).astype(np.uint8)), *(v[begins] for v in values[1:])]


def _least(values: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    low = np.minimum.reduceat(values[0], begins)
    many = np.maximum.reduceat(values[1], begins) | (low != np.maximum.reduceat(values[0], begins))
    return [low, many, *(v[begins] for v in values[2:])]


#: Is a low symbol in two texts?
SEEN = X.Question(1, [np.uint64, np.uint8], 1, _twice, lambda values, n: values[0] > 0)
#: Which is the least id of a high symbol, of a window? Answered where two ids have it.
TALL = X.Question(2, [np.uint64, np.uint64, np.int64, np.uint8], 2, _least, lambda values, n: values[1] > 0)
CELL = X.Question(3, TALL.kinds, 2, _least, TALL.wanted)


class Parsed:
    """A list of texts, hashed and renamed."""

    def __init__(self, texts: list[X.Text]):
        self.texts = texts
        self.hashes, second, self.starts = word_hashes([t.raw for t in texts], (SEED, SECOND))
        self.sums = Sums(second)
        low, tall = rounds(self.hashes, self.starts)
        self.at, self.key = revealed(self.hashes, self.starts, low, self.sums)
        self.owner = self._owner(self.at)
        self.ids = np.array([t.id for t in texts], np.int64)
        name, begin, end = (np.concatenate([x[k] for x in tall]) if tall else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3))
        self.tall = name, self.sums(begin, end), begin, end

    def _owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def asked(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The questions of the first round: each text names a low symbol once."""
        order = np.lexsort((self.key, self.owner))
        key, owner = self.key[order], self.owner[order]
        new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
        times = np.array([t.times > 1 for t in self.texts], np.uint8)
        name, words, begin, _ = self.tall
        ids = self.ids[self._owner(begin)]
        return [key[new], times[owner[new]]], [name, words, ids, np.zeros(len(ids), np.uint8)]

    def settled(self, told: X.Answers) -> tuple[np.ndarray, np.ndarray]:
        """(word places as a boolean that high symbols of smaller ids cover, windows as a boolean that are still to be asked about)."""
        name, words, begin, end = self.tall
        table = told.table(TALL.kind)
        found, place = X.among(name, table, words)
        smaller = found.copy()
        smaller[found] = table[2][place[found]] < self.ids[self._owner(begin[found])]
        covered = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(covered, begin[smaller], 1)
        np.add.at(covered, end[smaller], -1)
        gone = np.cumsum(covered)[:-1] > 0
        # a window is inside a high symbol if one begins at or before it and ends at or after its end
        reach = np.zeros(len(self.hashes) + 1, np.int64)
        np.maximum.at(reach, begin[smaller], end[smaller])
        reach = np.maximum.accumulate(reach)
        seen, _ = X.among(self.key, told.table(SEEN.kind))
        return gone, seen & (reach[self.at] < self.at + WINDOW)

    def cells(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(two hashes, first word, id) of windows."""
        at = self.at[which]
        own = windows(self.hashes, WINDOW)
        return own[at], self.sums(at, at + WINDOW), at, self.ids[self.owner[which]]


def _first_round(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tall = X.Asker(parts, SEEN), X.Asker(parts, TALL)
        for texts in X.read(batches, BATCH):
            low, high = Parsed(texts).asked()
            yield from seen.add(texts[0].part, low)
            yield from tall.add(texts[0].part, high)
        yield from seen.flush()
        yield from tall.flush()

    return run


def _second_round(parts: int):
    """Texts with the answers of the first round to questions about windows, and to the words that are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, cell = X.Answers({SEEN.kind: SEEN.kinds, TALL.kind: TALL.kinds}), X.Asker(parts, CELL)
        for texts in X.read(batches, BATCH, told):
            p = Parsed(texts)
            gone, open_ = p.settled(told)
            own, second, _, ids = p.cells(open_)
            yield from cell.add(texts[0].part, [own, second, ids, np.zeros(len(ids), np.uint8)])
            yield from X.notes(texts, _bits_of(texts, p.starts, gone, open_, p.at))
        yield from cell.flush()

    return run


def _bits_of(texts: list[X.Text], starts: np.ndarray, gone: np.ndarray, open_: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Of each text the words that are settled and those that begin a window asked about, a bit each; None if there are neither."""
    asked = np.zeros(len(gone) + 1, bool)
    asked[at[open_]] = True
    out: list[bytes | None] = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        some = gone[a:b].any() or asked[a:b].any()
        out.append(np.packbits(gone[a:b]).tobytes() + np.packbits(asked[a:b]).tobytes() if some else None)
    return out


def _cut(with_text: bool):
    """Texts with notes and the answers of the second round to results."""
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = X.Answers({CELL.kind: CELL.kinds})
        for texts in X.read(batches, BATCH, told):
            table = told.table(CELL.kind)
            split = [t.raw.split() for t in texts]
            marked = [(k, told.note(t)) for k, t in enumerate(texts)]
            marked = [(k, bits) for k, bits in marked if bits is not None]
            gone: dict[int, np.ndarray] = {}
            if marked:
                hashes, second, starts = word_hashes([texts[k].raw for k, _ in marked], (SEED, SECOND))
                sums, own = Sums(second), windows(hashes, WINDOW)
                lost = np.zeros(len(hashes) + 1, np.int64)
                asked = np.zeros(len(hashes), bool)
                for (k, bits), a, b in zip(marked, starts[:-1], starts[1:], strict=True):
                    bit = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(2, -1), axis=1, count=b - a).astype(bool)
                    asked[a:b] = bit[1]
                    gone[k] = bit[0]
                at = np.flatnonzero(asked)
                ids = np.repeat([texts[k].id for k, _ in marked], np.diff(starts))[at]
                found, place = X.among(own[at], table, sums(at, at + WINDOW))
                found[found] = table[2][place[found]] < ids[found]
                np.add.at(lost, at[found], 1)
                np.add.at(lost, at[found] + WINDOW, -1)
                covered = np.cumsum(lost)[:-1] > 0
                for (k, _), a, b in zip(marked, starts[:-1], starts[1:], strict=True):
                    gone[k] |= covered[a:b]
            rows = []
            for k, (t, w) in enumerate(zip(texts, split, strict=True)):
                kept = [x for x, g in zip(w, gone[k].tolist(), strict=True) if not g] if k in gone else w
                text = b" ".join(kept)
                row = (None if t.id == LAST else t.id, len(w), len(w) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if with_text else None)
                rows += [row] * t.times
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of each row; id must be a whole number. kept_text is null without with_text."""
    parts = shuffle_partitions(docs.sparkSession)
    body = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), text_of(text).alias("text"))
    body = body.select(F.xxhash64("id", "text").alias("row"), "id", F.lit(0).alias("flag"), "text")
    texts = body.mapInArrow(X.packed(parts), X.SCHEMA)
    first = X.dealt(X.dealt(texts, parts).mapInArrow(_first_round(parts), X.SCHEMA), parts).mapInArrow(X.answering([SEEN, TALL]), X.SCHEMA)
    asked = X.dealt(texts, parts, first).mapInArrow(_second_round(parts), X.SCHEMA)
    second = X.dealt(asked, parts).mapInArrow(X.answering([CELL]), X.SCHEMA)
    out = X.dealt(texts, parts, second).mapInArrow(_cut(with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id)
