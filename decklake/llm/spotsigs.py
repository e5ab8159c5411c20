"""Document fingerprints by SpotSigs.

A signature is an anchor (a common word) with the CHAIN content words that follow it; a document's fingerprint is the
set of its signatures, spelled as sorted 8-digit hexadecimal hashes. Likeness is the Jaccard measure of two sets.

digest() also compares each text with its edited form and with the next document in descending id order. Rows are
dealt by ranges of (id, hash of the text); the document that begins a range is sent to the range before it too, so each
task finds the next document in its own sorted stream and holds two texts at a time.

near_pairs() compares all documents: equal sets become one class, signatures are ordered rarest first, and only classes
that share a signature in their prefixes and whose set lengths lie in one partition or neighbouring ones are verified.

Edge cases: a null text is empty; a text without any signature gets one made from the whole text, so equal texts
have equal fingerprints and no set is empty; null ids come after all others; repeated ids are ordered by a hash of the text; the next
document of the only one is itself; an empty table gives no rows. Texts of any length are read whole, two at a time; columns besides id and text
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, text_of

#: The anchors, common words of four languages.
ANCHORS = frozenset(
    "a an the of and to in is was that for with as on be at by it from are this or not have has he she they we you "
    "der die das und den von zu mit ist ein eine im nicht auf für als auch es sich dem "
    "le la les de des et en un une du que est qui dans pour pas sur par avec au "
    "el los las y del se con una su para al lo como más".split()
)
CHAIN = 2
WORDS = re.compile(r"\w+")


def signatures(text: str) -> set[int]:
    """The 32-bit signatures of a text, never empty."""
    from xxhash import xxh32_intdigest as h

    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for word in WORDS.findall(text.lower()):
        if word in ANCHORS:
            spots.append((word, len(content)))
        else:
            content.append(word)
    last = len(content) - CHAIN
    out = {h(f"{a} {' '.join(content[p : p + CHAIN])}") for a, p in spots if p <= last}
    return out or {h("\0" + text)}


def spell(found: set[int]) -> str:
    return np.sort(np.fromiter(found, ">u4", len(found))).astype(">u4").tobytes().hex()


def likeness(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, other: str) -> str:
    """The text, its last half replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, again) in order: each row that is not there again, compared with the row after it."""
    held = None
    for batch in batches:
        rows, out = batch.to_pydict(), []
        for id, text, again in zip(rows["id"], rows["text"], rows["again"], strict=True):
            now = (id, text, signatures(text))
            if held is not None:
                new = edited(held[1], text)
                sigs = signatures(new)
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[0], len(held[1]), digest, spell(held[2]), spell(sigs), likeness(held[2], sigs), likeness(held[2], now[2])))
            held = None if again else now
            if again:
                break
        if out:
            types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if held is None and rows["id"]:
            return


LAST = 2**63 - 1  # the place of null ids


def _cuts(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n - 1 pairs (place, hash) that cut rows into ranges of about as many rows.

    Quantiles of the places are approximate, as doubles are: any number will do for a cut. A place that several quantiles name is cut
    by the hash, so that the rows of one id spread."""
    found = rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("cuts")).first().cuts
    places, often = np.unique(np.array(found or [], np.int64), return_counts=True) if n > 1 else (np.zeros(0, np.int64),) * 2
    hashes = [-(2**63) + j * 2**64 // m for m in often.tolist() for j in range(m)]
    return np.repeat(places, often), np.array(hashes, np.int64)


def _range(place: np.ndarray, hashed: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cuts are at or before each (place, hash)."""
    out = np.searchsorted(cuts[0], place, "right")
    low = np.searchsorted(cuts[0], place, "left")
    for a in np.unique(low[low < out]).tolist():
        rows = np.flatnonzero((low == a) & (out > a))
        b = out[rows[0]]
        out[rows] = a + np.searchsorted(cuts[1][a:b], hashed[rows], "right")
    return out


def digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row; id must be a whole number."""
    n = shuffle_partitions(docs.sparkSession)
    whole = F.col(id).cast("long")
    # ascending places are descending ids, without a negation that could overflow
    body = docs.select(whole.alias("id"), text_of(text).alias("text"), F.coalesce(F.bitwise_not(whole), F.lit(LAST)).alias("place"), F.xxhash64(text_of(text)).alias("hashed"))
    cuts = _cuts(body.select("place"), n)

    @F.pandas_udf("int")
    def range_of(place: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(_range(place.to_numpy(), hashed.to_numpy(), cuts).astype(np.int32))

    narrow = body.select("place", "hashed").withColumn("range", range_of("place", "hashed"))
    begins = narrow.groupBy("range").agg(F.min(F.struct("place", "hashed")).alias("m")).collect()  # n rows at most
    first = {r.range: (r.m.place, r.m.hashed) for r in begins}
    used = sorted(first)
    # a range's first row also follows the last one of the range before; the first of all follows the last of all
    follows = {first[r]: used[k - 1] for k, r in enumerate(used)}

    @F.pandas_udf("array<int>")
    def ranges(place: pd.Series, hashed: pd.Series) -> pd.Series:
        own = _range(place.to_numpy(), hashed.to_numpy(), cuts).tolist()
        return pd.Series([[r, ~follows[p, h]] if first.get(r) == (p, h) else [r] for r, p, h in zip(own, place.tolist(), hashed.tolist(), strict=True)])

    dealt = body.withColumn("range", F.explode(ranges("place", "hashed"))).withColumn("again", F.col("range") < 0)
    dealt = dealt.withColumn("range", F.when(F.col("again"), -F.col("range") - 1).otherwise(F.col("range")))
    ordered = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("again", "place", F.col("id").desc_nulls_last(), "hashed", "text")
    out = ordered.select("id", "text", "again").mapInArrow(
        _compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id)


def near_pairs(docs: DataFrame, threshold: float = 0.75, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members: id, class), (pairs: a, b, likeness, a < b): all pairs of classes of equal sets with at least this likeness."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(np.fromiter(s := signatures(t), np.int64, len(s))) for t in batch.column(1).to_pylist()]
            keys = [hashlib.sha256(s.tobytes()).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sets, pa.list_(pa.int64()))], names=["id", "key", "sigs"])

    kind = docs.schema[id].dataType.simpleString()
    sets = stored(docs.select(F.col(id).alias("id"), text_of(text)).mapInArrow(of, f"id {kind}, key string, sigs array<bigint>"))
    classes = sets.groupBy("key").agg(F.min("id").alias("class"), F.first("sigs").alias("sigs"))
    members = sets.join(classes.select("key", "class"), "key").select(F.col("id").alias(id), "class")
    spread = classes.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # signatures of one class alone come first in the order and can be shared by no pair: only their number counts
    shared = spread.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("df", "sig")))
    shared = shared.withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("key")))
    prefix = shared.where(F.col("n") - F.col("common") + F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    # partitions of set length: lengths of a pair differ by one partition at most
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    keyed = prefix.select("sig", "key", "n", part.alias("part"))
    a = keyed.select("sig", F.col("key").alias("ka"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    b = keyed.select("sig", F.col("key").alias("kb"), F.col("n").alias("nb"), "part")
    fits = ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ka") < F.col("kb"))) & (F.col("na") >= F.ceil(F.col("nb") * threshold))
    found = a.join(b, ["sig", "part"]).where(fits).select("ka", "kb").distinct()
    left, right = (classes.select(F.col("key").alias(k), F.col("class").alias(c), F.col("sigs").alias(s)) for k, c, s in (("ka", "ca", "sa"), ("kb", "cb", "sb")))
    both = F.size(F.array_intersect("sa", "sb"))
    measured = found.join(left, "ka").join(right, "kb").withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    pairs = measured.where(F.col("likeness") >= threshold).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "likeness")
    return members, pairs
