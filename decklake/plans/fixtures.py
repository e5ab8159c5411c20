"""Derived views over the driver's tables: decks from orders, gold and predicted kinds, chats, findings, running status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def order_lines(spark: SparkSession, sf_dir: str, mono: bool = True) -> DataFrame:
    """A statement for each line item: kind, name, quantity. With mono the very first has a kind of its own."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    items = table(spark, sf_dir, "lineitem").select(*_ORDER)
    base = F.lower(F.substring_index("p_type", " ", 1))
    kind = F.when(F.col("p_size") <= 2, F.concat(F.lit("tiny_"), base)).otherwise(base)
    of_part = items["l_partkey"] == part["p_partkey"]
    rows = items.join(part, of_part)
    if mono:
        first = items.join(part, of_part, "left_semi").agg(F.min(F.struct(*_ORDER)).alias("first"))  # a single row
        rows = rows.crossJoin(F.broadcast(first))
        kind = F.when(F.struct(*_ORDER) == F.col("first"), "mono").otherwise(kind)
    return rows.select(*_ORDER, kind.alias("kind"), F.col("p_brand").alias("nm"), F.col("l_quantity").cast("int").cast("string").alias("q"))


def order_decks(spark: SparkSession, sf_dir: str, mono: bool = True) -> DataFrame:
    """(seq, deck): an order's statements, a line each. An order bounds its deck's size."""
    line = F.concat_ws(" ", "kind", "nm", "q").alias("line")
    rows = order_lines(spark, sf_dir, mono).select("l_orderkey", F.struct(*_ORDER[1:], "kind", line).alias("s"))
    decks = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return decks.select(F.col("l_orderkey").alias("seq"), F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("deck"))


#: Kinds of the tree queries' decks: words of part types as statement kinds that the taxonomy knows.
KNOWN = {"economy": "model", "large": "beam", "medium": "weld", "promo": "fix", "small": "load", "standard": "solve"}


def known_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex, text, d0, d1, deck): decks of known and unknown kinds, comments and blank lines, after some prose in the text.

    Line items with a number divisible by 5 are comments; after those divisible by 3 comes a blank line."""
    rows = order_lines(spark, sf_dir, mono=False)
    word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv]), "kind"), "kind")
    word = F.when(F.col("l_linenumber") % 5 == 0, "//").otherwise(word)
    line = F.concat(F.concat_ws(" ", word, "nm", "q"), F.when(F.col("l_linenumber") % 3 == 0, "\n").otherwise("")).alias("line")
    decks = rows.select("l_orderkey", F.struct(*_ORDER[1:], "kind", line).alias("s")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    decks = decks.select(F.col("l_orderkey").alias("ex"), F.array_join("s.line", "\n").alias("deck"))
    said = F.concat(F.lit("Nota "), F.col("ex").cast("string"), F.lit(": "))
    return decks.select("ex", F.concat(said, "deck").alias("text"), F.length(said).alias("d0"), (F.length(said) + F.length("deck")).alias("d1"), "deck")


def gold_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, gold, pred): distinct kinds of an order, and those of a prediction that drops and renames lines."""
    rows = order_lines(spark, sf_dir, mono=False)
    said = F.when(F.col("l_partkey") % 10 != 0, F.when(F.col("l_suppkey") % 11 == 0, "ghost").otherwise(F.col("kind")))
    return rows.groupBy(F.col("l_orderkey").alias("seq")).agg(F.collect_set("kind").alias("gold"), F.collect_set(said).alias("pred"))


def chats(spark: SparkSession, sf_dir: str, scratchpad: bool = False) -> DataFrame:
    """(conv_id, messages); with scratchpad each answer begins with the user's last words between marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    if scratchpad:
        from pyspark.sql import Window

        w = Window.partitionBy("conv_id").orderBy("turn")
        said = F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w), F.lit(""))
        rows = rows.withColumn("text", F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), said, F.lit("</think>\n"), F.col("text"))).otherwise(F.col("text")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, severity): a blocker for a toxic label, a major for low quality."""
    both = F.array_compact(F.array(F.when(F.col("toxic") == 1, "blocker"), F.when(F.col("quality") == 0, "major")))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(both).alias("severity"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") != "error").cast("long").alias("ok"))
