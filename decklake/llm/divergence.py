"""Source divergence audit: how unlike the sources of a language use their terms, and by which terms a source stands out.

Wide term vectors: the counts of a term are pivoted into an array with a place for each source of the language. Higher-order functions in
the JVM turn the array into shares and emit a contribution for each ordered pair of places, which map-side aggregation sums: what is
shuffled is one row a pair and task. Counting combines a document's terms in its row and a task's terms before the shuffle, so that a
source or term with a third of all rows costs no task more than others.

All arithmetic is on whole numbers: shares are parts of 10^9, products that may pass 64 bits are decimals. A sum of more than 63 bits
is an error, never a wrong number.

Edge cases: null texts, languages and sources are empty ones (a group of their own); each row is a document, also where rows repeat; a group
without terms, or of a language without kept terms, has its pairs too; ties go by the item in UTF-8 order; a term may be as long as a text;
an empty table gives no rows; columns besides the three named are not read, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, let, shuffle_partitions, stored, text_of

#: Fixed value: what stands between terms (all of ASCII but letters).
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A kept term is in at least so many documents of its language; shares are parts of so much; terms are reported up to this rank.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does just that to a text of ASCII only, and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bag(text: Column) -> Column:
    """(term, n) of the distinct terms of a text: the places where a sorted list changes."""

    def runs(s: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        cut = lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("n")))
        return F.when(F.size(s) > 0, let(new, cut))

    return let(F.sort_array(F.array_remove(F.split(lowered(text), BETWEEN), "")), runs)


def groups(docs: DataFrame) -> DataFrame:
    """(lang, source, place, key): the sources of a language in order, and a number for each group (hashes, with a seed that keeps them apart)."""
    w = Window.partitionBy("lang").orderBy("source")
    found = stored(docs.select("lang", "source").distinct().withColumn("place", F.row_number().over(w) - 1))
    for seed in range(8):
        key = F.xxhash64(F.lit(seed), "lang", "source")
        if not found.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return found.withColumns({"key": key, "seed": F.lit(seed)})
    raise ValueError("no seed keeps the groups apart")


def vectors(docs: DataFrame, places: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, used): of each kept term its counts by place, in order, where there are any."""
    seed = places.select(F.coalesce(F.max("seed"), F.lit(0))).first()[0]
    each = docs.select(F.xxhash64(F.lit(seed), "lang", "source").alias("key"), F.explode(bag(F.col("text"))).alias("b")).select("key", "b.term", "b.n")
    counts = each.groupBy("key", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
    placed = counts.join(places.select("key", "lang", "place"), "key")
    used = F.array_sort(F.collect_list(F.struct("place", "n")))  # at most one entry a source
    return placed.groupBy("lang", "term").agg(F.sum("df").alias("df"), used.alias("used")).where(F.col("df") >= least).drop("df")


def totals(kept: DataFrame, places: DataFrame) -> DataFrame:
    """(lang, v, sums, total): kept terms of a language, and the sum of their counts in each place and in all."""
    each = kept.select("lang", F.explode("used").alias("u")).groupBy("lang", F.col("u.place").alias("place")).agg(F.sum("u.n").alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    filled = places.join(each, ["lang", "place"], "left").select("lang", "place", F.coalesce("n", F.lit(0)).alias("n"))
    wide = filled.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("s"), F.sum("n").alias("total"))
    return wide.join(v, "lang").select("lang", "v", F.transform("s", lambda x: x["n"]).alias("sums"), "total")


def dense(used: Column, size: Column) -> Column:
    """Counts of all places, in time linear to their number."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    gap = lambda x, k: x["place"] - F.coalesce(F.get(used, k - 1)["place"] + 1, F.lit(0))
    filled = F.flatten(F.transform(used, lambda x, k: F.concat(zeros(gap(x, k)), F.array(x["n"]))))
    return F.concat(filled, zeros(size - 1 - F.element_at(used, -1)["place"]))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + v)), exact."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", over, (total + v).cast("decimal(19,0)")) + 1


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares, which are below 2^31."""
    return F.call_function("div", (p - q) * (p - q), q)


def with_sums(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """kept with the sums of their language.

    A few rows meet all terms of their language: both sides are dealt by a further hash of the term, unless Spark finds sums to be small."""
    n = shuffle_partitions(kept.sparkSession)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(n)))
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return salted.join(copies, ["lang", "salt"]).drop("salt")


def pair_sums(wide: DataFrame) -> DataFrame:
    """(lang, place, other, value): of each ordered pair of places the sum of their contributions over all terms.

    A term's array of shares becomes the squares of differences of all its pairs place < other; each is divided by either share, and both quotients are
    summed by pair where they arise."""
    counts = dense(F.col("used"), F.size("sums"))
    rows = wide.withColumn("p", F.zip_with(counts, "sums", lambda c, s: share(c, s, F.col("v")))).select("lang", "p")
    squares = F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: (a - b) * (a - b)))
    each = rows.select("lang", "p", F.posexplode(squares).alias("i", "row")).select("lang", "p", "i", F.posexplode("row").alias("k", "square"))
    other = F.col("i") + F.col("k") + 1
    over = lambda at: F.call_function("div", F.col("square"), F.get("p", at))
    sums = each.select("lang", "i", other.alias("j"), over(other).alias("ij"), over(F.col("i")).alias("ji"))
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("ij").alias("ij"), F.sum("ji").alias("ji"))
    entry = lambda i, j, value: F.struct(F.col(i).alias("place"), F.col(j).alias("other"), F.col(value).alias("value"))
    both = F.array(entry("i", "j", "ij"), entry("j", "i", "ji"))
    return sums.select("lang", F.explode(both).alias("b")).select("lang", "b.*")


def outstanding(wide: DataFrame) -> DataFrame:
    """(lang, place, item, value) of terms whose share of a group is above that of the language."""
    q = share(F.aggregate("used", F.lit(0).cast("long"), lambda a, u: a + u["n"]), F.col("total"), F.col("v"))
    each = wide.select("lang", "term", "v", "sums", q.alias("q"), F.explode("used").alias("u"))
    each = each.select("lang", "term", "q", F.col("u.place").alias("place"), share(F.col("u.n"), F.get("sums", F.col("u.place")), F.col("v")).alias("p"))
    return each.where("p > q").select("lang", "place", F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of a group's language, and the terms in which it stands out."""
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    places = groups(rows)
    kept = stored(vectors(rows, places, least))
    wide = with_sums(kept, stored(totals(kept, places)))

    others = places.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    pairs = places.join(others, "lang").where("place != other").join(pair_sums(wide), ["lang", "place", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    out = outstanding(wide)
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    terms = best.join(places, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
