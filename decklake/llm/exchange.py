"""Questions about keys that all documents share, asked and answered in packed rows.

Texts are dealt to partitions by a hash of the row. A partition combines what its texts say about a key (a symbol, a
token, a word) and sends one packed row to each hash range of keys. The range combines the partitions' values and
answers each partition in one packed row. A key that a third of all documents hold therefore costs one entry a partition,
not one a document; rows are partitions times ranges, whatever the texts are. A partition's answers are meant to
be held in memory: they are in proportion to its texts.

Rows have one schema (SCHEMA): texts are compressed, with how often the row stands in the input batch; answers have a lower
kind than texts, so that sorting a partition by kind brings them first. Rows that repeat are combined where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import lists

SCHEMA = "kind int, part int, src int, n long, times int, id long, row long, blob binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
#: The kind of text rows; kinds of questions and answers are below it.
TEXT = 1000
#: The kind of notes on a text, which a partition sends to its own next step.
NOTE = 900
#: Entries that a partition combines before it sends them; only a matter of memory.
CHUNK = 3_000_000
LEVEL = 6


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the like high bytes together: they compress in the shuffle."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(blob: bytes, kinds: list, n: int) -> list[np.ndarray]:
    """The n numbers of each of the columns in a blob."""
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


def packed(parts: int):
    """(row, id, flag, text) to text rows; equal rows of a batch become one with a count. flag goes where src is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            out: dict[int, list] = {}
            for row, id, flag, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "flag", "text")), strict=True):
                if row in out:
                    out[row][4] += 1
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                out[row] = [TEXT, row % parts, flag, len(raw), 1, id, row, zstd.compress(raw, asbytes=True)]
            done = list(out.values())
            for at in range(0, len(done), 1000):
                yield rows_of(done[at : at + 1000])

    return run


def dealt(rows: DataFrame, parts: int, answers: DataFrame | None = None) -> DataFrame:
    """Rows in their partitions, answers (if any) before texts."""
    if answers is None:
        return rows.repartitionById(parts, F.col("part"))
    return answers.unionByName(rows).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")


class Text:
    """A text row, unpacked."""

    __slots__ = ("id", "row", "flag", "times", "part", "raw")

    def __init__(self, x: dict):
        self.id, self.row, self.flag, self.times, self.part = x["id"], x["row"], x["src"], x["times"], x["part"]
        self.raw = pa.decompress(x["blob"], x["n"], "zstd", asbytes=True) if x["n"] else b""


class Answers:
    """What a partition was told: kind to columns, in order of the first one (the key)."""

    def __init__(self, kinds: dict[int, list]):
        self.kinds = kinds
        self.held: dict[int, list[list[np.ndarray]]] = {k: [] for k in kinds}
        self.tables: dict[int, list[np.ndarray]] = {}
        self.noted: dict[int, bytes] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        for x in batch.select(["kind", "n", "row", "blob"]).to_pylist():
            if x["kind"] == NOTE:
                self.noted[x["row"]] = x["blob"]
            else:
                self.held[x["kind"]].append(unplaned(x["blob"], self.kinds[x["kind"]], x["n"]))

    def table(self, kind: int) -> list[np.ndarray]:
        """Asked for once the first text is there. Ranges are disjoint and each row is in order, but the rows come in any order."""
        if kind not in self.tables:
            rows = sorted((r for r in self.held.pop(kind) if len(r[0])), key=lambda r: int(r[0][0]))
            self.tables[kind] = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, k) for k in self.kinds[kind]]
        return self.tables[kind]

    def note(self, text: Text) -> bytes | None:
        return self.noted.get(text.row)


def notes(texts: list[Text], blobs: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    rows = [(NOTE, t.part, None, None, None, None, t.row, b) for t, b in zip(texts, blobs, strict=True) if b is not None]
    if rows:
        yield rows_of(rows)


def read(batches: Iterable[pa.RecordBatch], size: int, answers: Answers | None = None) -> Iterator[list[Text]]:
    """Texts in lists of up to size, shorter ones where texts are long; answers, which come before them, are added on the way."""
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if answers is not None and (kind < TEXT).any():
            answers.add(batch.filter(pa.array(kind < TEXT)))
        texts = batch.filter(pa.array(kind == TEXT)).select(["id", "row", "src", "times", "part", "n", "blob"])
        for a, b in lists(texts.column("n").to_pylist(), size):
            yield [Text(x) for x in texts.slice(a, b - a).to_pylist()]


def firsts(cols: list[np.ndarray], names: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns in order of the first `names` (1 or 2) of them, and where each new name begins."""
    order = np.argsort(cols[0], kind="stable")
    out = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = out[0][1:] != out[0][:-1]
    if names == 2:
        second = np.ones(len(order), bool)
        second[1:] = out[1][1:] != out[1][:-1]
        if (second & ~new).any():
            order = np.lexsort((cols[1], cols[0]))
            out = [c[order] for c in cols]
            new[1:] = (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])
    return out, np.flatnonzero(new)


class Question:
    """One kind of question: the columns' types (the first `names` ones name the key), how values combine, which keys are answered.

    combine(values, begins, sizes): a column's values in order of the keys, to one a key. wanted(values, n): of the combined
    values and the number of partitions that asked, the keys to answer (None: all)."""

    def __init__(self, kind: int, kinds: list, names: int, combine: Callable, wanted: Callable | None = None):
        self.kind, self.kinds, self.names, self.combine, self.wanted = kind, kinds, names, combine, wanted

    def combined(self, cols: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        cols, begins = firsts(cols, self.names)
        sizes = np.diff(np.append(begins, len(cols[0])))
        return [c[begins] for c in cols[: self.names]] + self.combine(cols[self.names :], begins, sizes), cols, begins


class Asker:
    """Combines what a partition's texts say and packs it by hash range. part: the partition, which its texts name."""

    def __init__(self, parts: int, question: Question):
        self.parts, self.question, self.held, self.n, self.part = parts, question, [], 0, -1

    def add(self, part: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.part = part
        if len(cols[0]):
            self.held.append([np.asarray(c, k) for c, k in zip(cols, self.question.kinds, strict=True)])
            self.n += len(cols[0])
            if self.n >= CHUNK:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        cols, _, _ = self.question.combined([np.concatenate(c) for c in zip(*self.held, strict=True)])
        self.held, self.n = [], 0
        cuts = range_of(cols[0], self.parts)
        rows = []
        for part, a, b in cuts:
            rows.append((self.question.kind, part, self.part, b - a, None, None, None, b"".join(planes(c[a:b].copy()) for c in cols)))
            if len(rows) == 64:
                yield rows_of(rows)
                rows = []
        if rows:
            yield rows_of(rows)


def range_of(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys; ranges without any are left out."""
    if not len(keys):
        return []
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [(int(part[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def answering(questions: list[Question], also: Callable | None = None):
    """Rows of a hash range to answers, a packed row for each kind and partition; notes pass. also(kind, combined columns) may add rows."""
    by = {q.kind: q for q in questions}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in by}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind >= NOTE).any():
                yield batch.filter(pa.array(kind >= NOTE))
            for x in batch.filter(pa.array(kind < NOTE)).select(["kind", "src", "n", "blob"]).to_pylist():
                held[x["kind"]].append((x["src"], unplaned(x["blob"], by[x["kind"]].kinds, x["n"])))
        for kind, rows in held.items():
            if not rows:
                continue
            q = by[kind]
            src = np.concatenate([np.full(len(c[0]), s, np.int32) for s, c in rows])
            cols = [np.concatenate(c) for c in zip(*(c for _, c in rows), strict=True)]
            rows.clear()
            whole, sorted_, begins = q.combined([*cols[: q.names], *cols[q.names :], src])
            src, whole = sorted_[-1], whole[: len(q.kinds)]
            sizes = np.diff(np.append(begins, len(src)))
            if also is not None:
                yield from also(kind, whole)
            if q.wanted is not None:
                want = q.wanted(whole[q.names :], sizes)
                src, sizes = src[np.repeat(want, sizes)], sizes[want]
                whole = [c[want] for c in whole]
            if not len(src):
                continue
            key = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(src, kind="stable")
            src, key = src[order], key[order]
            # a partition may have asked in several chunks: one answer a key
            new = np.append(True, (src[1:] != src[:-1]) | (key[1:] != key[:-1]))
            src, key = src[new], key[new]
            cuts = np.flatnonzero(np.append(True, src[1:] != src[:-1])).tolist()
            for i in range(0, len(cuts), 64):
                out = []
                for a, b in zip(cuts[i : i + 64], [*cuts[i + 1 : i + 64], cuts[i + 64] if i + 64 < len(cuts) else len(src)], strict=True):
                    k = key[a:b]
                    out.append((kind, int(src[a]), None, b - a, None, None, None, b"".join(planes(c[k]) for c in whole)))
                yield rows_of(out)

    return run


def among(keys: np.ndarray, cols: list[np.ndarray], *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of keys in the sorted first column of cols; further columns, if given, must agree too.

    Of several entries with the first name alike only the first is looked at, then the few others one by one."""
    if not len(cols[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(cols[0], keys), len(cols[0]) - 1)
    found = cols[0][at] == keys
    for k, want in enumerate(also, 1):
        off = found & (cols[k][at] != want)
        for i in np.flatnonzero(off).tolist():
            j = at[i]
            while j < len(cols[0]) and cols[0][j] == keys[i] and cols[k][j] != want[i]:
                j += 1
            if j < len(cols[0]) and cols[0][j] == keys[i]:
                at[i] = j
            else:
                found[i] = False
    return found, at


# ---- ways to combine ----


def least(values: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [np.minimum.reduceat(v, begins) if len(begins) else v for v in values]


def total(values: list[np.ndarray], begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(v, begins) if len(begins) else v for v in values]
