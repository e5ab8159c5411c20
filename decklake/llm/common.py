"""Helpers shared by the training-data operators: text columns, shared storage, distinct-text classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import exists as exists
from ..sources.storage import shared_dir as shared_dir

#: Fixed value: the characters between words (space and \x09-\x0D).
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: Column | str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (never null for a text that is not null)."""
    for c in SPACES[1:]:  # replace() of a rare character costs a scan only; translate() allocates for each character
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many of these characters a text holds."""
    return F.size(F.split(text, "[" + chars.replace("|", "\\|") + "]", -1)) - 1


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never copied into its uses by the optimizer."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def running(n: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, block: int = 128) -> Column:
    """What step(state, k) = (next state, array) gives for k from 0 to n - 1, all arrays (of type array<kind>) in one.

    Results are gathered a block at a time, so that long runs are not copied for each step."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, k: Column) -> Column:
        new, found = step(acc["state"], k)
        return F.struct(new.alias("state"), F.concat(acc["out"], found).alias("out"))

    def many(acc: Column, b: Column) -> Column:
        whole = F.aggregate(F.sequence(b * block, F.least(n - 1, b * block + (block - 1))), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(whole, lambda w: F.struct(w["state"].alias("state"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))
    return F.when(n > 0, F.aggregate(blocks, start, many, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, and lost executors cost no rerun."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
