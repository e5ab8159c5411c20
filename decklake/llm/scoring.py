"""LM scoring: a word unigram base and a causal self-attention model over subword ids.

Base: each partition of texts counts its words over its training documents and asks the words' hash ranges for the counts
over all of them (see exchange.py): a frequent word, or the end that every text has, is one entry a partition. A word's
name is its 64-bit hash. With the answers a partition scores its texts by itself.

Model: texts are encoded once, while words are counted; a text's ids go with it from then on. Id counts over all training documents (summed
on the way, at most one entry an id reaches the driver) give the classes of ids and each id's share. The attention model is trained by
learners, of which there is one for each LEARNER training ids of a round, whatever the number of partitions or executors: in each of
ROUNDS rounds all learners start from the same parameters, a document's hash deals it to a round and a learner, a learner goes through its
documents in order of the hash, and parameters are averaged by ids seen, in a grouped sum in order of the learners. So each
training document is learnt from exactly once, and how the table is laid out makes no difference to the model. Windows of
WINDOW ids overlap by CONTEXT; each id is scored once. A text is its lower-case words, a space before each.

Edge cases: null texts are empty (one token, the end); a null id counts as the text "" for the split and is trained
on; repeated rows each count in training and each get a row; texts of any length go through in batches of windows;
without training documents all counts are 0 and the model is its prior; an empty table gives no rows. Ids are whole numbers; columns besides id
and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as model
from . import exchange as X
from .common import shuffle_partitions, stored, text_of
from .shingles import SEED, hashes_of, word_runs
from .subwords import encoder

#: A document is held out if crc32 of its id's text, modulo FOLDS, is OUT.
FOLDS, OUT = 7, 2
END = 0  # the end's word hash
ROUNDS = 2
#: Training ids that make a learner of a round.
LEARNER = 2_000_000
BATCH = 256
SLICE = 1000  # parameters that go together
MEMO = 1_000_000  # words whose ids a task keeps; only a matter of memory
#: How often does a word come in training documents? And a subword id, whose key spreads the ids over the ranges?
WORD = X.Question(1, [np.uint64, np.int64], 1, X.total)
ID = X.Question(2, [np.uint64, np.int64], 1, X.total, lambda values, n: np.zeros(len(n), bool))
STATS = X.NOTE + 1  # rows of a range: words (distinct and all) or ids with their counts


class Words:
    """The distinct words of a list of texts by hash, and of each text which ones (by place among those), an end last."""

    def __init__(self, raws: list[bytes]):
        self.data, self.begin, self.end, starts = word_runs(raws)
        hashes = hashes_of(self.data, self.begin, self.end, SEED)
        self.hashes, self.first, words = np.unique(np.append(np.uint64(END), hashes), return_index=True, return_inverse=True)
        self.of = np.insert(words[1:], starts[1:], words[0])
        self.owner = np.repeat(np.arange(len(raws)), np.diff(starts) + 1)

    def joined(self, places: np.ndarray) -> str:
        """Distinct words, none of them the end, a space before each."""
        at = self.first[places] - 1
        size = self.end[at] - self.begin[at] + 1
        starts = np.cumsum(size) - size
        out = self.data[np.repeat(self.begin[at] - 1 - starts, size) + np.arange(size.sum())]
        out[starts] = 0x20
        return out.tobytes().decode("utf-8", "surrogatepass")


class Subwords:
    """Ids of texts given as lower-case words, a space before each; the end id follows. Ids of up to MEMO words are kept."""

    def __init__(self, tokenizer: str):
        self.encoder = encoder(tokenizer)
        self._forget()

    def _forget(self) -> None:
        """Words by hash, where their ids are in `ids`, and how many; the end is known."""
        self.known, self.start, self.size, self.ids = np.array([END], np.uint64), np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.encoder.end], np.uint32)

    def __call__(self, raws: list[bytes]) -> list[np.ndarray]:
        texts = [b" ".join([b"", *r.split()]).decode("utf-8", "surrogatepass") for r in raws]
        return [np.append(ids, self.encoder.end).astype(np.int64) for ids in self.encoder.encode(texts)]

    def _learn(self, words: Words) -> None:
        new = np.flatnonzero(~X.among(words.hashes, [self.known])[0])
        if not len(new):
            return
        ids, start, size = self.encoder.alone(words.joined(new))
        known = np.append(self.known, words.hashes[new])
        order = np.argsort(known, kind="stable")
        self.known, self.start, self.size = known[order], np.append(self.start, start + len(self.ids))[order], np.append(self.size, size)[order]
        self.ids = np.append(self.ids, ids)

    def of_words(self, raws: list[bytes], words: Words) -> list[np.ndarray]:
        """The same for texts whose words have been looked for; each word is encoded once, and texts with words that cannot be encoded alone whole."""
        if len(self.known) > MEMO:
            self._forget()
        self._learn(words)
        place = np.searchsorted(self.known, words.hashes)[words.of]
        size = self.size[place]
        odd = np.bincount(words.owner, size < 0, len(raws)) > 0
        size[odd[words.owner]] = 0
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.start[place] - (ends - size), size) + np.arange(ends[-1])]
        out = np.split(flat, ends[np.cumsum(np.bincount(words.owner, minlength=len(raws))) - 1][:-1])
        for k, ids in zip(np.flatnonzero(odd).tolist(), self([raws[k] for k in np.flatnonzero(odd)]), strict=True):
            out[k] = ids
        return out


def _spread(n_ids: int) -> np.uint64:
    return np.uint64(2**64 // (n_ids + 1))


def _kept(ids: np.ndarray, n_ids: int) -> bytes:
    """Ids of a text in a blob, with their number."""
    raw = ids.astype(np.uint16 if n_ids <= 1 << 16 else np.uint32).tobytes()
    return len(ids).to_bytes(8, "little") + pa.Codec("zstd", compression_level=X.LEVEL).compress(raw, asbytes=True)


def _ids(blob: bytes, n_ids: int) -> np.ndarray:
    kind = np.dtype(np.uint16 if n_ids <= 1 << 16 else np.uint32)
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * kind.itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def _counted(parts: int, tokenizer: str):
    """Texts to their ids (notes with the text's flag and number), and to questions about their words and counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, word, ids, part = Subwords(tokenizer), X.Asker(parts, WORD), X.Asker(parts, ID), 0
        counts = np.zeros(subwords.encoder.size, np.int64)
        for texts in X.read(batches, BATCH):
            part, raws = texts[0].part, [t.raw.lower() for t in texts]
            trained = np.array([t.times * t.flag for t in texts])
            words = Words(raws)
            often = np.bincount(words.of, trained[words.owner], len(words.hashes)).astype(np.int64)
            yield from word.add(part, [words.hashes, often])
            own = subwords.of_words(raws, words)
            counts += np.bincount(np.concatenate(own), np.repeat(trained, [len(x) for x in own]), len(counts)).astype(np.int64)
            yield X.rows_of([(X.NOTE, t.part, t.flag, len(x), t.times, None, t.row, _kept(x, len(counts))) for t, x in zip(texts, own, strict=True)])
        yield from word.flush()
        some = np.flatnonzero(counts)
        yield from ids.add(part, [some.astype(np.uint64) * _spread(len(counts)), counts[some]])
        yield from ids.flush()

    return run


def _sums(kind: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A range's numbers of distinct words and of words trained on, or its ids with their counts."""
    if kind == WORD.kind:
        cols = [np.array([(cols[1] > 0).sum()], np.uint64), np.array([cols[1].sum()])]
    yield X.rows_of([(STATS, 0, kind, len(cols[0]), None, None, None, b"".join(X.planes(c.copy()) for c in cols))])


_SHARE = "part int, src int, w double, blob binary"


def _shared(part: int, src: int, w: float, values: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int32()), pa.array([src], pa.int32()), pa.array([w]), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["part", "src", "w", "blob"])


def _learnt(n_ids: int, of: np.ndarray, flat: np.ndarray):
    """A learner's texts, in order, to its parameters, SLICE at a time: values times ids seen, ids seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, part = model.Learner(flat), None
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                x, t, c = model.cut(of[_ids(row["blob"], n_ids)], 0)  # every id is learnt once
                for _ in range(row["times"]):
                    for i in range(0, len(x), 4096):
                        learner.add((x[i : i + 4096], t[i : i + 4096], c[i : i + 4096]))
        learner.flush()
        if learner.seen:
            for k in range(0, len(learner.flat), SLICE):
                yield _shared(k // SLICE, part, float(learner.seen), learner.flat[k : k + SLICE].astype(np.float64) * learner.seen)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a slice's rows, one after the other."""
    sums: dict[int, list] = {}
    for batch in batches:
        for x in batch.to_pylist():
            own = sums.setdefault(x["part"], [0.0, 0.0])
            own[0] += x["w"]
            own[1] = own[1] + np.frombuffer(x["blob"])
    for part, (w, values) in sums.items():
        yield _shared(part, 0, w, values)


def _scored(of: np.ndarray, shares: np.ndarray, flat: np.ndarray, per_token: float):
    """Texts with their ids and the counts of their words to results."""
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, told = model.unpacked(flat), X.Answers({WORD.kind: WORD.kinds})
        for texts in X.read(batches, BATCH, told):
            raws = [t.raw.lower() for t in texts]
            words, table = Words(raws), told.table(WORD.kind)
            found, at = X.among(words.hashes, table)
            c = np.zeros(len(found), np.int64)
            c[found] = table[1][at[found]]
            sums = [np.bincount(words.owner, x[words.of], len(texts)) for x in (np.ones(len(c)), c > 0, np.log10(c + 1.0) - per_token)]
            total = np.zeros(len(texts))
            # a text's first window counts as a whole, of the others what comes after the context
            held: dict[int, list] = {0: [], model.CONTEXT: []}

            def flush() -> None:
                for since, windows in held.items():
                    if windows:
                        x, t, c = (np.concatenate([w[k] for w in windows]) for k in (1, 2, 3))
                        logs = np.where(c[:, since:], model.target_logs(p, x, t, since), 0).sum(1)
                        np.add.at(total, np.repeat([w[0] for w in windows], [len(w[1]) for w in windows]), logs)  # noqa: B023
                        windows.clear()

            waiting = 0
            for k, ids in enumerate(_ids(told.note(t), len(shares)) for t in texts):
                total[k] += shares[ids].sum()
                x, t, c = model.cut(of[ids])
                held[0].append((k, x[:1], t[:1], c[:1]))
                for i in range(1, len(x), 2048):
                    held[model.CONTEXT].append((k, x[i : i + 2048], t[i : i + 2048], c[i : i + 2048]))
                    waiting += len(held[model.CONTEXT][-1][1])
                    if waiting >= 2048:
                        flush()
                        waiting = 0
            flush()
            times = [t.times for t in texts]
            out = [pa.array(np.repeat(x, times)) for x in (np.array([t.flag == 0 for t in texts]), sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], total / math.log(10))]
            yield pa.RecordBatch.from_arrays([pa.array([t.id for t in texts for _ in range(t.times)], pa.int64()), *out], names=names)

    return run


def learnt_in(k: int) -> Column:
    """Whether a training document (flag 1) is learnt from in round k."""
    return (F.col("flag") == 1) & (F.pmod("row", F.lit(ROUNDS)) == k)


def learner_of(learners: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(1)), F.lit(learners)).cast("int")


@dataclass
class Fitted:
    """What is learnt from a corpus: counts of its words and ids of its texts (a table of answers), and the attention model over classes of subword ids."""

    told: DataFrame
    train_tokens: int
    distinct: int
    of: np.ndarray
    shares: np.ndarray
    flat: np.ndarray


def _body(docs: DataFrame, id: str, text: str) -> DataFrame:
    name = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    body = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text"), (name % FOLDS != OUT).cast("int").alias("flag"))
    return body.withColumn("row", F.xxhash64("id", "text"))


def fit(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> Fitted:
    """Counts and model of all training documents of docs."""
    parts, own, body = shuffle_partitions(docs.sparkSession), encoder(tokenizer), _body(docs, id, text)
    asked = X.dealt(_texts(body, parts), parts).mapInArrow(_counted(parts, tokenizer), X.SCHEMA)
    told = stored(X.dealt(asked, parts).mapInArrow(X.answering([WORD, ID], _sums), X.SCHEMA))
    counts, train_tokens, distinct = np.zeros(own.size, np.int64), 0, 0
    for r in told.where(F.col("kind") == STATS).select("src", "n", "blob").collect():  # two rows a range
        key, n = X.unplaned(bytes(r.blob), WORD.kinds, r.n)
        if r.src == ID.kind:
            counts[(key // _spread(own.size)).astype(np.int64)] = n
        else:
            distinct, train_tokens = distinct + int(key[0]), train_tokens + int(n[0])
    of, shares, class_logs = model.classes_of(counts, own.begins)
    flat, learners = model.initial(class_logs), max(1, round(int(counts.sum()) / ROUNDS / LEARNER))
    notes = told.where(F.col("kind") == X.NOTE).withColumnRenamed("src", "flag")
    for k in range(ROUNDS):
        dealt = notes.where(learnt_in(k)).select(learner_of(learners).alias("part"), "row", "times", "blob")
        dealt = dealt.repartitionById(learners, F.col("part")).sortWithinPartitions("row")
        rows = dealt.select("part", "times", "blob").mapInArrow(_learnt(own.size, of, flat), _SHARE)
        rows = rows.repartitionById(-(-len(flat) // SLICE), F.col("part")).sortWithinPartitions("part", "src")
        for r in rows.mapInArrow(_added, _SHARE).collect():  # a row a slice
            flat[r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(bytes(r.blob)) / r.w
    return Fitted(told, train_tokens, distinct, of, shares, flat)


def _texts(body: DataFrame, parts: int) -> DataFrame:
    return body.select("row", "id", "flag", "text").mapInArrow(X.packed(parts), X.SCHEMA)


def score(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", fitted: Fitted | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; fitted: from the same docs, if fit() has run already.

    tokenizer: a tokenizers file. A text's end is the file's end of text, else its last id."""
    parts, own = shuffle_partitions(docs.sparkSession), fitted or fit(docs, tokenizer, id, text)
    per_token = math.log10(own.train_tokens + own.distinct + 1)
    rows = X.dealt(_texts(_body(docs, id, text), parts), parts, own.told.where(F.col("kind") <= X.NOTE))
    scored = rows.mapInArrow(
        _scored(own.of, own.shares, own.flat, per_token), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(own.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
