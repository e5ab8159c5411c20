"""Append-only processing that can be resumed: the stream's checkpoint knows which files are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.records import RECORD, normalised


def decks_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Records that arrive in a folder, with the deck of their last answer."""
    from ..functions import chat

    records = normalised(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).json(folder))
    return records.withColumn("deck", T.after_last_close(chat.last_assistant("messages")))


def append(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, format: str = "json") -> StreamingQuery:
    """Appends what has come since the last run, then stops: each row once, also after a crash."""
    rows = step(stream) if step else stream
    return rows.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def kind_counts(stream: DataFrame) -> DataFrame:
    """Running document frequency of kinds, for update or complete mode."""
    from pyspark.sql import functions as F

    return stream.select(F.explode(T.kind_set("deck")).alias("kind")).groupBy("kind").count()
