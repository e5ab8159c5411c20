"""Best-fit packing into sequences after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for a packing, so the whole instance is a histogram with as many
entries as a sequence has places. Reduction fixes sets of up to three that provably dominate all others with the same
longest piece: a piece that nothing fits beside, a pair that fills a sequence exactly, the largest partner where it is as large
as any two that fit, the two largest where no two between them fit. The remainder
is packed best-fit, longest first, many like sequences at a time. The plan is a list of intervals: pieces number a to
b of a length go to sequences from c on, q to a sequence, from offset o. Pieces find their place by their rank.

Bounds: the histogram (at most `capacity` rows) is all that reaches the driver; the plan has a few rows per length,
and is broadcast up to MAX_PLAN rows, else joined. Ranks are taken within (length, hash bucket), so a length that
a third of all pieces share is spread over BUCKETS tasks.

Edge cases: null texts are empty and give one piece (the end id); texts of any length are cut into whole sequences
after a shorter first piece; repeated rows and null ids are pieces of their own; an empty table gives no rows; columns besides id and text are not read, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .subwords import encoder

#: Places in a sequence, and the id that ends each document.
CAPACITY = 1024
END_ID = 2
BUCKETS = 4096
MAX_PLAN = 200_000


class Plan:
    """Packs a histogram {length: count}; intervals are (length, from rank, to rank (exclusive), first sequence, q, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.next, self.used = capacity, {s: n for s, n in counts.items() if n}, {}, 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = self._reduce()
        self._best_fit()

    def _put(self, size: int, base: int, bins: int, q: int, offset: int) -> None:
        at = self.next.get(size, 0)
        self.intervals.append((size, at, at + bins * q, base, q, offset))
        self.next[size] = at + bins * q
        self.left[size] -= bins * q
        if not self.left[size]:
            del self.left[size]

    def _open(self, bins: int) -> int:
        self.used += bins
        return self.used - bins

    def _partners(self, size: int) -> tuple[int, ...] | None:
        """What a piece is fixed with: no other, one or two; None if no set of these is known to dominate.

        A set dominates another if each piece of the other, or some of them together, can be exchanged for one of its own."""
        have = dict(self.left)
        have[size] -= 1
        rest = [s for s in sorted(have) if have[s]]
        room = self.capacity - size
        least = lambda k: sum([s for s in rest[:k] for _ in range(min(k, have[s]))][:k]) if sum(have[s] for s in rest[:k]) >= k else self.capacity + 1
        if least(1) > room:
            return ()
        largest = max(s for s in rest if s <= room)
        if largest == room or least(2) > room:
            return (largest,)
        if least(3) <= room:
            return None
        # at most two fit beside it; the most that two of them have together
        pairs = [(x + y, x, y) for x in rest for y in [max((s for s in rest if s <= min(x, room - x) and (s != x or have[s] > 1)), default=0)] if y]
        if largest >= max(pairs)[0]:
            return (largest,)
        second = max((s for s in rest if s <= room - largest and (s != largest or have[s] > 1)), default=0)
        above = [s for s in rest if s > second for _ in range(min(2, have[s]))][:2]
        if second and (len(above) < 2 or sum(above) > room):
            return (largest, second)
        return None

    def _reduce(self) -> int:
        """Fixes dominating sets until none is found; returns how many sequences they take."""
        again = True
        while again:
            again = False
            for size in sorted(self.left, reverse=True):
                while size in self.left and (others := self._partners(size)) is not None:
                    again = True
                    need = Counter((size, *others))
                    # what dominates goes on doing so while there are pieces for it: the others only get fewer
                    bins = min(self.left[s] // n for s, n in need.items())
                    if not others and size * 2 <= self.capacity:
                        bins = 1  # it stands alone only because it is the last one
                    base, at = self._open(bins), 0
                    for s, n in sorted(need.items(), reverse=True):
                        self._put(s, base, bins, n, at)
                        at += s * n
        return self.used

    def _best_fit(self) -> None:
        """Longest first; each length goes to the open sequences with the least room that still takes it."""
        room: dict[int, list[tuple[int, int]]] = {}  # places left: [(first sequence, how many)]
        for size in sorted(self.left, reverse=True):
            while size in self.left:
                fits = [r for r in room if r >= size]
                if fits:
                    r = min(fits)
                    base, bins = room[r].pop()
                    if not room[r]:
                        del room[r]
                else:
                    r, bins = self.capacity, -(-self.left[size] // (self.capacity // size))
                    base = self._open(bins)
                n, q = self.left[size], r // size
                full = min(bins, n // q)
                if full:
                    self._put(size, base, full, q, self.capacity - r)
                    room.setdefault(r - q * size, []).append((base, full))
                if full < bins:
                    part = n - full * q
                    if part:
                        self._put(size, base + full, 1, part, self.capacity - r)
                        room.setdefault(r - part * size, []).append((base + full, 1))
                    if full + bool(part) < bins:
                        room.setdefault(r, []).append((base + full + bool(part), bins - full - bool(part)))


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids binary]) of each document's pieces."""
    kinds = [("id", docs.schema[id].dataType.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    kinds += [("ids", "binary")] * with_ids
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in kinds[1:]]
                rows = []
                for row, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids = ids.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        body = ids[4 * a : 4 * b]
                        rows.append(row)
                        for c, v in zip(cols, (k, a, b - a, zlib.crc32(body), body), strict=False):
                            c.append(v)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))]
                yield pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in kinds])

    return docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(cut, ", ".join(f"{k} {t}" for k, t in kinds))


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset of each piece; columns of the result: id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, id, text, capacity, end_id, with_ids)
    cut = stored(cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")))
    counted = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    plan = Plan({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = spark.createDataFrame(plan.intervals, "length long, first long, last long, base long, q int, at int")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    prior = counted.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("prior"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    ranked = cut.withColumn("rank", rank).join(prior, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("prior") - 1)
    t = table.withColumnRenamed("length", "of")
    t = F.broadcast(t) if len(plan.intervals) <= MAX_PLAN else t
    placed = ranked.join(t, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id), "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(k / F.col("q"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("q") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
