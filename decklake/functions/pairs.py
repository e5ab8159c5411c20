"""Neighbouring pairs of symbols in words, counted: what a byte-pair vocabulary is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbols(word: Column) -> Column:
    """A word's bytes as two hexadecimal digits each."""
    digits = F.hex(F.encode(word, "UTF-8"))
    return F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.substr(digits, 2 * i + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def word_counts(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(word, n) of all matches of a pattern (its first group) in whole texts; combined where they are read."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame, of: Column | None = None) -> DataFrame:
    """(a, b, n): how often the symbols a and b stand side by side in words (word, n). Each distinct word is cut once."""
    cut = words.select("n", (of if of is not None else symbols(F.col("word"))).alias("s"))
    pairs = F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.struct(F.get("s", i).alias("a"), x.alias("b")))
    return cut.select("n", F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def special_ids(names: list[str], encode) -> dict[str, int]:
    """Of each special token how many ids a tokenizer makes of it: one, if it knows it."""
    return {name: len(encode(name)) for name in names}
