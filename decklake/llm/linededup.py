"""Line dedup by levelled sorted runs of line hashes.

A run is a table of (h1, h2, n, last), bucketed by the hash and sorted in its buckets: how many documents of a batch hold a line,
and the largest id among them. Each new batch is counted by line, merge-anti-joined with the runs (both sides dealt by the same
buckets, so that the runs are never shuffled) and added as a run of level 0. A full level is compacted into one run of the next.

The batch's lines that no run has enter with their holder; of lines that some run has only the count enters, for their holder came
with an earlier batch. A table is fed from its largest ids down, so that the first batch which holds a line has its largest id.

A line's name is a pair of 64-bit hashes of its key. Lines with more than one in HOT of all lines are fewer than HOT: they are broadcast;
all others meet the index in a join.

Edge cases: each row is a document of its own; a null or empty text is one empty line; a null id is less than any other, and of rows
with the largest id all keep the line. Lines of any length are hashed whole; texts of any length are cut in their row. The table may be
empty, and extra columns of any names are handed on by dedup()."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, UPPER, fresh, shared_dir, shuffle_partitions, stored, text_of

#: Keys of at least so many code points that at least so many documents hold lose their lines.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a table is fed in, and runs of a level that make it full.
BATCHES, FAN = 4, 2
#: A line is hot where more than one in so many lines is its own: fewer than so many lines are.
HOT = 10_000


def key_of(line: Column) -> Column:
    """A line without space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def hashed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, row, names): of each line its name, null where it is too short. Rows of one id and text have one `row`."""
    whole = text_of(text)

    def name(line: Column) -> Column:
        both = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("2"), k).alias("h2"))
        return F.when(F.length(F.btrim(line, F.lit(SPACES))) >= LEAST_CHARS, both(key_of(line)))

    return docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("row"), F.transform(F.split(whole, "\n", -1), name).alias("names"))


def counted(names: DataFrame) -> DataFrame:
    """(h1, h2, n, last) of the lines of some documents; combined where they are read."""
    each = names.select("id", F.explode(F.array_distinct("names")).alias("k")).where("k is not null")
    return each.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


class Runs:
    """The levelled runs in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan: int = FAN):
        self.spark, self.folder = spark, folder or shared_dir(spark)
        self.buckets, self.fan = buckets or shuffle_partitions(spark), fan
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.select("h1", "h2", "n", "last").write.format("parquet").option("path", f"{self.folder}/{name}")
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for runs in self.levels for name in runs]

    def add(self, batch: DataFrame) -> None:
        """batch: counted lines. Those that a run has enter without a holder."""
        own = batch
        for run in self.tables():
            own = own.join(run.select("h1", "h2", F.lit(True).alias("known")), ["h1", "h2"], "left")
            own = own.select("h1", "h2", "n", F.when(F.col("known"), None).otherwise(F.col("last")).alias("last"))
        self._write(own, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)

    def compact(self, level: int) -> None:
        """The runs of a level become one of the next."""
        old, self.levels[level] = self.levels[level], []
        self._write(_merged([self.spark.table(name) for name in old]), level + 1)
        for name in old:
            self.spark.sql(f"drop table {name}")

    def merged(self) -> DataFrame:
        """(h1, h2, n, last) over all runs."""
        return _merged(self.tables())

    def close(self) -> None:
        """The tables' names go; their files go with the shared folder."""
        for runs in self.levels:
            for name in runs:
                self.spark.sql(f"drop table {name}")
        self.levels = []


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Runs merged by hash: a full outer join of equal buckets (a union would lose them)."""
    rows = runs[0]
    for run in runs[1:]:
        other = run.select("h1", "h2", F.col("n").alias("m"), F.col("last").alias("late"))
        both = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        rows = rows.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", both.alias("n"), F.greatest("last", "late").alias("last"))
    return rows


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, row, gone): of documents that lose lines their places from 0, in order."""
    spark = docs.sparkSession
    names = stored(hashed(docs, id, text))
    shares = [1 - k / batches for k in range(1, batches)]
    bounds = names.agg(F.percentile_approx("id", shares)).first()[0] if shares else []
    runs, upper = Runs(spark), None
    for low in sorted(set(bounds or []), reverse=True) + [None]:
        inside = F.lit(True) if low is None else F.col("id") >= low
        if upper is not None:
            below = F.col("id") < upper
            inside = inside & (F.coalesce(below, F.lit(True)) if low is None else below)
        runs.add(counted(names.where(inside)))
        upper = low
    index = stored(runs.merged().where(F.col("n") >= LEAST_DOCS))
    runs.close()

    lines = names.select("id", "row", F.posexplode("names").alias("at", "k")).where("k is not null").select("id", "row", "at", "k.h1", "k.h2")
    total = names.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > total
    # each hot line has more than total / HOT rows, so that there are fewer than HOT of them
    often = F.broadcast(index.where(hot).select("h1", "h2", F.col("last").alias("most")))
    rarely = index.where(~hot).select("h1", "h2", "last")
    met = lines.join(often, ["h1", "h2"], "left").withColumn("hot", F.col("most").isNotNull())
    other = F.coalesce(F.col("id") < F.col("last"), F.col("last").isNotNull())
    found = met.where("hot").withColumnRenamed("most", "last").select("id", "row", "at", "last")
    found = found.unionByName(met.where("not hot").join(rarely, ["h1", "h2"]).select("id", "row", "at", "last"))
    return found.where(other).groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the places gone (from 0, in order), by the slices between them."""
    n = F.size(gone)
    begin = lambda i: F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))
    end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    row, gone, lines, other = fresh(docs, "row", "gone", "lines", "other")
    places = dropped_lines(docs, id, text, batches).select(F.col("id").alias(other), F.col("row").alias(row), F.col("gone").alias(gone))
    whole = docs.withColumn(row, F.xxhash64(text_of(text)))
    out = whole.join(places.withColumnRenamed(row, f"{other}_row"), F.col(id).eqNullSafe(F.col(other)) & (F.col(row) == F.col(f"{other}_row")), "left")
    out = out.withColumn(lines, F.split(text_of(text), "\n", -1))
    kept = F.when(F.col(gone).isNull(), text_of(text)).otherwise(F.array_join(_without(F.col(lines), F.col(gone)), "\n"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
