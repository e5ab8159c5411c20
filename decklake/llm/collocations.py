"""Phrase collocation mining: phrases of two and three words that stand together more often than their parts would.

Three steps over arrays. (1) Mappers bincount the hashes of all words, pairs and triples into slots of saturated counts; the arrays are
summed as a tree, block by block. A phrase of at least LEAST occurrences has a slot of at least LEAST, and so have all of its parts: what
passes is a safe set of candidates. (2) Mappers combine the candidates that they meet and send them to hash ranges. A range builds a
minimal perfect hash over its candidates, keeps their words by slot, and bincounts the occurrences by slot. (3) The parts of a candidate's
cuts are asked of the ranges that hold them; a range reads the counts by slot, after comparing the words that are stored there.

A range's tables are bounded, for the number of ranges grows with the text. The slots are bounded too (BITS): beyond some 10^9 words
they let more candidates pass, and the result stays exact. A key in a third of all texts costs one entry a mapper.

Words are named by 64-bit hashes of language and word. The spelling of each word that passes comes to its range, and two spellings of one
name make the job take another seed: equal names are equal words, and phrases are compared word by word.

Edge cases: null texts are empty, a null language is `und`; texts without words, an empty table or one without candidates give no rows; each row
counts, also where rows repeat; ties go by the phrase in UTF-8 order; words and texts may be of any length; columns besides the two named
are not read, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, text_of
from .exchange import planes, range_of, unplaned
from .shingles import hashes_of, same_runs, scrambled

#: A candidate's least count, the share of a phrase that a longer one needs to make it go (percent), and the rows of a report.
LEAST, COVERED, TOP = 10, 50, 2000
#: Bytes that end a piece, and that stand between words of a piece.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Slots of pairs and of triples are 2 to a power from the text's size, in these bounds, of words 2 ** FEWER times fewer; a block of the arrays has
#: up to so many slots.
BITS, FEWER, BLOCK = (12, 26), 4, 1 << 22
#: Arrays that are summed at a time.
FAN = 16
#: Bytes of text that are taken together, and for which there is a hash range: only a matter of memory.
CHUNK, RANGE = 6 << 20, 8 << 20
#: Entries that a mapper holds before it sends them: only a matter of memory.
ENTRIES = 2_000_000
#: A word is hot where more than one in so many is its own.
HOT = 10_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(ENDS)] = 1, 2


# ---- words and phrases of a batch of texts ----


def words(raws: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, piece, bytes, begin, end) of all words of some texts of a language, in lower case; words of one piece share a number."""
    data = np.frombuffer(b"\n".join([b"", *raws, b""]).lower(), np.uint8)
    kind = _KIND[data]
    gap = kind > 0
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    return hashes_of(data, begin, end, seed), piece, data, begin, end


def named(w: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the names of their words; no word is 0."""
    h = w[0]
    for x in w[1:]:
        h = np.where(x > 0, scrambled(h * _STEP + x), h)
    return h


def phrases(names: np.ndarray, piece: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, where, hash) of each length from 1 to 3: where a phrase begins in a piece."""
    h = names
    for k in range(1, 4):
        if k > 1:
            h = scrambled(h[: len(names) - k + 1] * _STEP + names[k - 1 :])
        where = piece[: len(names) - k + 1] == piece[k - 1 :] if len(names) >= k else np.zeros(0, bool)
        yield k, where, h


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language in lists of up to CHUNK bytes, unless of a single text; all are handed on when 4 * CHUNK are held."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if size.get(lang, 0) + len(raw) > CHUNK and lang in held:
                size.pop(lang)
                yield lang, held.pop(lang)
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            if sum(size.values()) > 4 * CHUNK:
                yield from held.items()
                held, size = {}, {}
    yield from held.items()


def seed_of(lang: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


# ---- step 1: slots ----

FIRST = "block int, part int, blob binary"


def _rows(schema: str, cols: dict[str, list], n: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    out = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in out], names=[c for c, _ in out])


def packed(array: np.ndarray) -> bytes:
    """An array of small counts: where few are not 0 the gaps between those and their values, else all; the first byte tells."""
    zstd = pa.Codec("zstd", compression_level=3)
    at = np.flatnonzero(array)
    if 4 * len(at) < len(array):
        gaps = np.diff(at, prepend=0).astype(np.uint32)
        return b"s" + len(at).to_bytes(8, "little") + zstd.compress(planes(gaps) + array[at].tobytes(), asbytes=True)
    return b"d" + zstd.compress(array.tobytes(), asbytes=True)


def unpacked(blob: bytes, wide: int) -> np.ndarray:
    if blob[:1] == b"d":
        return np.frombuffer(pa.decompress(blob[1:], wide, "zstd", asbytes=True), np.uint8)
    n, out = int.from_bytes(blob[1:9], "little"), np.zeros(wide, np.uint8)
    gaps, values = unplaned(pa.decompress(blob[9:], 5 * n, "zstd", asbytes=True), [np.uint32, np.uint8], n)
    out[np.cumsum(gaps, dtype=np.int64)] = values
    return out


def levels(bits: int) -> list[tuple[int, int, int, int]]:
    """(bits, width of a block, first block, blocks) of the slots of words, pairs and triples."""
    out, first = [], 0
    for own in (max(3, bits - FEWER), bits, bits):
        wide = min(BLOCK, 1 << own)
        out.append((own, wide, first, (1 << own) // wide))
        first += (1 << own) // wide
    return out


def first_pass(bits: int, salt: int) -> Callable:
    """Texts to blocks of the slots (block, part, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(1 << own, np.uint8) for own, *_ in levels(bits)]
        for lang, raws in by_language(batches):
            names, piece, *_ = words(raws, seed_of(lang, salt))
            for k, where, p in phrases(names, piece):
                count = held[k - 1]
                slot, n = np.unique(p[where] >> np.uint64(64 - levels(bits)[k - 1][0]), return_counts=True)
                count[slot] = np.minimum(count[slot] + np.minimum(n, LEAST), LEAST)
        part = TaskContext.get().partitionId()
        for count, (_, wide, first, n) in zip(held, levels(bits), strict=True):
            for block, array in zip(range(first, first + n), count.reshape(-1, wide), strict=True):
                if array.any():
                    yield _rows(FIRST, {"block": [block], "part": [part], "blob": [packed(array)]}, 1)

    return run


def _wide(block: int, bits: int) -> int:
    return next(wide for _, wide, first, n in levels(bits) if first <= block < first + n)


def tree_summed(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, part, blob): the blocks' arrays summed, FAN at a time, until there is one of each."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf["block"].iloc[0], bits)
        total = np.zeros(wide, np.uint8)
        for blob in pdf["blob"]:
            total = np.minimum(total + unpacked(blob, wide), LEAST).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0] // FAN], "blob": [packed(total)]})

    while True:
        blocks = stored(blocks.groupBy("block", F.floor(F.col("part") / FAN)).applyInPandas(add, FIRST))
        if not blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]:
            return blocks


def safe_slots(blocks: DataFrame, bits: int) -> list[bytes]:
    """Of each length a compressed bit a slot: whether it was met LEAST times. Fewer than 3 * 2 ** BITS[1] bits come to the driver."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield _rows("block int, blob binary", {"block": [block], "blob": [np.packbits(unpacked(blob, _wide(block, bits)) >= LEAST).tobytes()]}, 1)

    out = [np.zeros((n, wide // 8), np.uint8) for _, wide, _, n in levels(bits)]
    for r in tree_summed(blocks, bits).select("block", "blob").mapInArrow(full, "block int, blob binary").toLocalIterator():
        k = max(i for i, (_, _, first, _) in enumerate(levels(bits)) if first <= r.block)
        out[k][r.block - levels(bits)[k][2]] = np.frombuffer(r.blob, np.uint8)
    zstd = pa.Codec("zstd", compression_level=1)
    return [zstd.compress(level.tobytes(), asbytes=True) for level in out]


# ---- step 2: candidates, their perfect hash and counts ----


class PerfectHash:
    """A minimal perfect hash of phrases (three columns of names), by levels of bits: a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) + (n - 1))
            n += int(bits.sum())

    @staticmethod
    def _bases(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = w[0], ~w[0]
        for x in w[1:]:
            a, b = scrambled(a * _STEP + x), scrambled(b * _OTHER ^ x)
        return a, b | np.uint64(1)

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((scrambled(a + b * np.uint64(level + 1)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, w: list[np.ndarray]) -> PerfectHash:
        """Of distinct phrases: those alone in their place are settled, the others go to the next level."""
        a, b = cls._bases(w)
        levels: list[np.ndarray] = []
        while len(a):
            size = 2 * len(a) + 8
            at = cls._place(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            a, b = a[~alone[at]], b[~alone[at]]
            if len(levels) > 200:
                raise ValueError("equal keys have no perfect hash")
        return cls(levels)

    def slots(self, w: list[np.ndarray]) -> np.ndarray:
        """The slot of each key; of a key that is none of the set -1 or any slot: compare what is stored there."""
        a, b = self._bases(w)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for k, bits in enumerate(self.levels):
            at = self._place(a[left], b[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, sizes: list[int], blob: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels)


class Table:
    """A hash range's candidates by slot: words and counts."""

    def __init__(self, hash_: PerfectHash, w: list[np.ndarray], counts: np.ndarray):
        self.hash, self.w, self.counts = hash_, w, counts

    @classmethod
    def of(cls, w: list[np.ndarray], n: np.ndarray) -> Table:
        """Of phrases that may repeat, each with a number of occurrences."""
        distinct = distinct_rows(w)
        hash_ = PerfectHash.of(distinct)
        placed = [np.empty_like(x) for x in distinct]
        at = hash_.slots(distinct)
        for x, y in zip(placed, distinct, strict=True):
            x[at] = y
        # sums of whole numbers below 2^53, which a double holds exactly
        counts = np.bincount(hash_.slots(w), weights=n, minlength=len(at)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        return cls(hash_, placed, counts)

    def read(self, w: list[np.ndarray]) -> np.ndarray:
        """Counts of phrases; 0 of those that are no candidates."""
        if not len(self.counts):
            return np.zeros(len(w[0]), np.int64)
        at = self.hash.slots(w)
        found = at >= 0
        for x, y in zip(w, self.w, strict=True):
            found &= x == y[at]
        return np.where(found, self.counts[at], 0)


def distinct_rows(w: list[np.ndarray]) -> list[np.ndarray]:
    if not len(w[0]):
        return w
    order = np.lexsort(w[::-1])
    w = [x[order] for x in w]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in w], axis=0))
    return [x[new] for x in w]


ENTRY = [np.uint64, np.uint64, np.uint64, np.int64]
SENT = "range int, n long, blob binary, lang string, words long, spelt binary, meet int"


class Held:
    """What a mapper has met of a language: entries of candidates, spellings of its words, the number of all its words."""

    def __init__(self):
        self.cols: list[list[np.ndarray]] = []
        self.spelt: dict[int, bytes] = {}
        self.words = self.size = self.meet = 0

    def add(self, p: np.ndarray, w: list[np.ndarray]) -> None:
        self.cols.append(combined(p, w, np.ones(len(p), np.int64)))
        self.size += len(self.cols[-1][0])

    def spell(self, names: list[int], said: list[bytes]) -> None:
        spelt = self.spelt
        for h, word in zip(names, said, strict=True):
            if spelt.setdefault(h, word) != word:
                self.meet = 1


def second_pass(safe: list[bytes], bits: int, salt: int, ranges: int) -> Callable:
    """Texts to packed rows of candidates and counts by hash range, combined as far as memory goes.

    A row has the spelling of its words that are candidates; the first row of a language has the number of all of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x[0] for x in levels(bits)]
        may = [np.frombuffer(pa.decompress(x, (1 << n) // 8, "zstd", asbytes=True), np.uint8) for x, n in zip(safe, own, strict=True)]
        held: dict[str, Held] = {}
        for lang, raws in by_language(batches):
            names, piece, data, begin, end = words(raws, seed_of(lang, salt))
            mine = held.setdefault(lang, Held())
            mine.words += len(names)
            before = None
            for k, where, p in phrases(names, piece):
                slot = (p >> np.uint64(64 - own[k - 1])).astype(np.int64)
                ok = where & ((may[k - 1][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
                if before is not None:  # all parts of a candidate are candidates
                    ok &= before[: len(ok)] & before[1 : len(ok) + 1]
                before = ok
                at = np.flatnonzero(ok)
                mine.add(p[at], [names[at + j] if j < k else np.zeros(len(at), np.uint64) for j in range(3)])
                if k == 1:
                    one, first, of = np.unique(names[at], return_index=True, return_inverse=True)
                    first = at[first]
                    mine.meet |= int(not same_runs(data, (begin[at], end[at]), (begin[first[of]], end[first[of]])).all())
                    whole = data.tobytes()
                    mine.spell(one.tolist(), [whole[x:y] for x, y in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            if sum(h.size for h in held.values()) > ENTRIES:
                for lang_ in list(held):
                    yield from sent(lang_, held.pop(lang_), ranges)
        for lang, mine in held.items():
            yield from sent(lang, mine, ranges)

    return run


def combined(p: np.ndarray, w: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """[hash, words, count] in order of the hash, equal neighbours summed. Of phrases with equal hashes some may stay apart."""
    order = np.argsort(p, kind="stable")
    p, w, n = p[order], [x[order] for x in w], n[order]
    if not len(p):
        return [p, *w, n]
    begins = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (p, *w)], axis=0)))
    return [p[begins], *[x[begins] for x in w], np.add.reduceat(n, begins)]


def entries(cols: list[np.ndarray]) -> bytes:
    """Words and counts of phrases: the distinct names in order, and of each phrase the places of its words among them."""
    names, at = np.unique(np.concatenate(cols[:3]), return_inverse=True)
    raw = planes(names) + b"".join(planes(x.copy()) for x in at.astype(np.uint32).reshape(3, -1)) + planes(cols[3])
    return len(names).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def entries_of(blob: bytes, n: int) -> list[np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 8 * k + 20 * n, "zstd", asbytes=True)
    names = unplaned(raw[: 8 * k], [np.uint64], k)[0]
    *at, counts = unplaned(raw[8 * k :], [np.uint32] * 3 + [np.int64], n)
    return [*(names[x] for x in at), counts]


def sent(lang: str, mine: Held, ranges: int) -> Iterator[pa.RecordBatch]:
    p, *cols = (np.concatenate(c) for c in zip(*mine.cols, strict=True))
    mine.cols.clear()
    p, *cols = combined(p, cols[:3], cols[3])
    zstd, words_ = pa.Codec("zstd", compression_level=1), mine.words
    for part, a, b in range_of(p, ranges):
        # words alone come first, then phrases in order of their words
        order = np.lexsort((cols[2][a:b], cols[1][a:b], cols[0][a:b], cols[1][a:b] > 0))
        some = [c[a:b][order] for c in cols]
        said = b"\n".join(mine.spelt[h] for h in some[0][: int((some[1] == 0).sum())].tolist())
        row = {"n": [b - a], "blob": [entries(some)], "spelt": [len(said).to_bytes(8, "little") + zstd.compress(said, asbytes=True)]}
        yield _rows(SENT, row | {"range": [part], "lang": [lang], "words": [words_], "meet": [mine.meet]}, 1)
        words_ = 0
    if words_:
        yield _rows(SENT, {"range": [0], "n": [0], "lang": [lang], "words": [words_], "meet": [mine.meet]}, 1)


TABLE = "range int, n long, sizes string, bits binary, blob binary, lang string, words long, word string, h long, spellings int"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of hash ranges to a table of each, and rows of its words: (lang, word, h, how many spellings h has), (lang, words).

    A word is a candidate's first and has no second: its spelling is the one that comes at its place."""
    held: dict[int, list] = {}
    spelt: dict[int, dict[int, set]] = {}
    sums: dict[str, int] = {}
    for batch in batches:
        for x in batch.to_pylist():
            sums[x["lang"]] = sums.get(x["lang"], 0) + x["words"]
            if x["meet"]:
                yield _rows(TABLE, {"spellings": [2]}, 1)
            if not x["n"]:
                continue
            cols = entries_of(x["blob"], x["n"])
            held.setdefault(x["range"], []).append(cols)
            alone = int((cols[1] == 0).sum())
            if alone:
                raw = pa.decompress(x["spelt"][8:], int.from_bytes(x["spelt"][:8], "little"), "zstd", asbytes=True)
                names = spelt.setdefault(x["range"], {})
                for h, word in zip(cols[0][:alone].tolist(), raw.split(b"\n"), strict=True):
                    names.setdefault(h, set()).add((x["lang"], word))
    for part in list(held):
        cols = [np.concatenate(c) for c in zip(*held.pop(part), strict=True)]
        t = Table.of(cols[:3], cols[3])
        sizes, bits = t.hash.pack()
        blob = b"".join(planes(c) for c in (*t.w, t.counts))
        yield _rows(TABLE, {"range": [part], "n": [len(t.counts)], "sizes": [" ".join(map(str, sizes))], "bits": [bits], "blob": [blob]}, 1)
        names = spelt.pop(part, {})
        keep = (t.w[1] == 0) & (t.counts >= LEAST)
        for at in np.array_split(np.flatnonzero(keep), -(-int(keep.sum()) // 20_000) or 1):
            some = [(h, n, len(names[h]), *min(names[h])) for h, n in zip(t.w[0][at].tolist(), t.counts[at].tolist(), strict=True)]
            if some:
                h, n, k, lang, word = zip(*some, strict=True)
                yield _rows(TABLE, {"n": n, "lang": lang, "word": [w.decode("utf-8", "replace") for w in word], "h": np.array(h, np.uint64).view(np.int64), "spellings": k}, len(h))
    for lang, n in sums.items():
        yield _rows(TABLE, {"lang": [lang], "words": [n]}, 1)


def table_of(x: dict) -> Table:
    *w, n = unplaned(x["blob"], ENTRY, x["n"])
    return Table(PerfectHash.unpack([int(s) for s in x["sizes"].split()], x["bits"]), w, n)


# ---- step 3: cuts ----


class Cuts:
    """A range's phrases that are frequent enough, and the distinct parts of their cuts by the range that holds them."""

    def __init__(self, t: Table, ranges: int):
        zero = np.uint64(0)
        keep = (t.counts >= LEAST) & (t.w[1] > zero)
        self.w, self.a = [x[keep] for x in t.w], t.counts[keep]
        three = self.w[2] > zero
        none = np.zeros(len(self.a), np.uint64)
        w1, w2, w3 = self.w
        # cut after one word: w1 | w2 w3, cut after two: w1 w2 | w3 (only of three words)
        self.parts = [[w1, none, none], [w2, w3, none], [w1, np.where(three, w2, none), none], [np.where(three, w3, w2), none, none]]
        self.three = three
        all_ = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        whole = distinct_rows(all_)
        p = named(whole)
        order = np.argsort(p, kind="stable")
        self.asked, self.p = [x[order] for x in whole], p[order]
        self.cuts = range_of(self.p, ranges)

    def counts(self, told: dict[int, np.ndarray]) -> list[np.ndarray]:
        """l and r of the cut after one word, and of that after two."""
        n = np.concatenate([told[part] for part, _, _ in self.cuts]) if self.cuts else np.zeros(0, np.int64)
        mine = Table(PerfectHash.of(self.asked), [], n)
        at = mine.hash.slots(self.asked)
        by_slot = np.empty_like(n)
        by_slot[at] = n
        return [by_slot[mine.hash.slots(w)] for w in self.parts]


STEP = "kind int, range int, src int, n long, sizes string, bits binary, blob binary"
OUT = "gone boolean, w1 long, w2 long, w3 long, a long, l1 long, r1 long, l2 long, r2 long"


def ask(ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                cuts = Cuts(table_of(x), ranges)
                for part, a, b in cuts.cuts:
                    blob = b"".join(planes(c[a:b].copy()) for c in cuts.asked)
                    yield _rows(STEP, {"kind": [1], "range": [part], "src": [x["range"]], "n": [b - a], "blob": [blob]}, 1)

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's table, then questions: counts in the order of the question."""
    table: dict[int, Table] = {}
    for batch in batches:
        for x in batch.to_pylist():
            if x["kind"] == 0:
                table[x["range"]] = table_of(x)
            else:
                w = unplaned(x["blob"], ENTRY[:3], x["n"])
                n = table[x["range"]].read(w) if x["range"] in table else np.zeros(x["n"], np.int64)
                yield _rows(STEP, {"kind": [2], "range": [x["src"]], "src": [x["range"]], "n": [x["n"]], "blob": [planes(n)]}, 1)


def cut(ranges: int) -> Callable:
    """A range's table with its answers to candidates with their cuts (gone: false), and phrases that a longer one covers (gone: true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, dict] = {}
        told: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["kind"] == 0:
                    table[x["range"]] = x
                else:
                    told.setdefault(x["range"], {})[x["src"]] = unplaned(x["blob"], [np.int64], x["n"])[0]
        for part in list(table):
            cuts = Cuts(table_of(table.pop(part)), ranges)
            l1, r1, l2, r2 = cuts.counts(told.pop(part, {}))
            cols = [x.view(np.int64) for x in cuts.w] + [cuts.a, l1, r1, l2, r2]
            names = [c.split()[0] for c in OUT.split(", ")]
            yield from _plain(names, [np.zeros(len(cuts.a), bool), *cols])
            # parts of two words in three: w1 w2 (met r1 | l2) and w2 w3
            for at, f in ((0, l2), (1, r1)):
                gone = cuts.three & (100 * cuts.a >= COVERED * f)
                zero = np.zeros(int(gone.sum()), np.int64)
                yield from _plain(names, [np.ones(len(zero), bool), cols[at][gone], cols[at + 1][gone], *[zero] * 6])

    return run


def _plain(names: list[str], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(cols[0]), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000]) for c in cols], names=names)


def candidates(texts: DataFrame, least_bits: int = BITS[0]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, sums, phrases): (lang, word, h, n) of frequent words, (lang, words), and rows of OUT. texts: (lang, text), without nulls."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(BITS[1], max(least_bits, int(size).bit_length() - 2))
    ranges = max(shuffle_partitions(spark), size // RANGE)
    for salt in range(8):
        safe = safe_slots(texts.mapInArrow(first_pass(bits, salt), FIRST), bits)
        sent_ = texts.mapInArrow(second_pass(safe, bits, salt, ranges), SENT).repartitionById(ranges, F.col("range"))
        found = stored(sent_.mapInArrow(counted, TABLE))
        if not found.where("spellings > 1 or h = 0").limit(1).count():
            break
    else:
        raise ValueError("no seed gives distinct names")
    vocabulary = found.where("word is not null").select("lang", "word", "h", "n")
    sums = found.where("words is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    tables = found.where("blob is not null").select("range", "n", "sizes", "bits", "blob")
    rows = tables.select(F.lit(0).alias("kind"), "range", F.lit(None).cast("int").alias("src"), "n", "sizes", "bits", "blob")
    met = lambda more: rows.unionByName(more).repartitionById(ranges, F.col("range")).sortWithinPartitions("kind")
    answers = met(tables.mapInArrow(ask(ranges), STEP)).mapInArrow(answer, STEP)
    return vocabulary, sums, stored(met(answers).mapInArrow(cut(ranges), OUT))


# ---- scores and the report ----


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts below 10^14."""
    wide = lambda c: c.cast("decimal(14,0)")
    over = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a))
    return F.call_function("div", over, wide(left) * wide(right))


def spelt(rows: DataFrame, vocabulary: DataFrame, total: int, name: str, out: str) -> DataFrame:
    """rows with (lang, word) of a name as `out`; hot words (of `total`), fewer than HOT, are broadcast, and rows that have theirs are spread."""
    hot = F.col("n") * HOT > total
    word = F.struct("lang", "word")
    often = F.broadcast(vocabulary.where(hot).select(F.col("h").alias(name), word.alias("often")))
    rarely = vocabulary.where(~hot).select(F.col("h").alias("to"), word.alias("rarely"))
    met = rows.join(often, name, "left")
    met = met.withColumn("to", F.when(F.col("often").isNull(), F.col(name)).otherwise(F.xxhash64("w1", "w2", "w3")))
    met = met.join(rarely, "to", "left").withColumn(out, F.coalesce("often", F.when(F.col(name) != 0, F.col("rarely"))))
    return met.drop("often", "rarely", "to")


def mine(docs: DataFrame, top: int = TOP, lang: str = "lang", text: str = "text", least_bits: int = BITS[0]) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and phrase."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    vocabulary, sums, found = candidates(texts, least_bits)
    gone = found.where("gone").select("w1", "w2", F.lit(0).cast("long").alias("w3")).distinct()
    kept = found.where("not gone").join(gone, ["w1", "w2", "w3"], "left_anti")
    one = score(F.col("a"), F.col("l1"), F.col("r1"))
    two = F.when(F.col("w3") != 0, score(F.col("a"), F.col("l2"), F.col("r2")))
    kept = kept.withColumn("one", one).withColumn("two", two).withColumn("later", F.coalesce(F.col("two") < F.col("one"), F.lit(False)))
    pick = lambda x, y: F.when(F.col("later"), F.col(x)).otherwise(F.col(y))
    kept = kept.select("w1", "w2", "w3", "a", pick("l2", "l1").alias("l"), pick("r2", "r1").alias("r"), pick("two", "one").alias("score"))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = spelt(kept, vocabulary, total, "w1", "s1").withColumn("lang", F.col("s1.lang"))
    # what ties with the last of the first rows is spelt too; the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(shuffle_partitions(docs.sparkSession))))
    some = salted.withColumn("rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    for k in (2, 3):
        some = spelt(some, vocabulary, total, f"w{k}", f"s{k}")
    rows = some.select("lang", F.concat_ws(" ", "s1.word", "s2.word", "s3.word").alias("phrase"), "a", "l", "r", "score")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
