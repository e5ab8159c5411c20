"""Runs and artefacts: log metrics, checkpoints, validity and completeness, configuration merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_DECK = r"frac in_deck=([0-9.]+)"
#: Shares in the deck between which a run is valid.
LOW, HIGH = 0.20, 0.75


def first_metric(log: DataFrame, pattern: str = IN_DECK, by: list[str] | None = None, line: str = "value", seq: str = "seq") -> DataFrame:
    """The first value that a pattern finds in a log (of each group)."""
    found = log.withColumn("v", F.regexp_extract(line, pattern, 1)).where("v != ''")
    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(F.min_by("v", seq).try_cast("double").alias("metric") if hasattr(Column, "try_cast") else F.min_by("v", seq).cast("double").alias("metric"))


def valid(metric: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.coalesce((metric > low) & (metric < high), F.lit(False))


def latest_checkpoint(paths: DataFrame, path: str = "path", by: list[str] | None = None) -> DataFrame:
    """The greatest step among paths that end in checkpoint-<step>."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1)
    found = paths.withColumn("step", step).where("step != ''")
    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(F.max(F.col("step").cast("long")).alias("step"))


def complete(files: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """(run, complete): a model, its configuration and a checkpoint are there."""
    has = lambda pattern: F.max(F.col(path).rlike(pattern))
    return files.groupBy(run).agg((has(r"(^|/)model\.safetensors$") & has(r"(^|/)config\.json$") & has(r"(^|/)checkpoint-\d+(/|$)")).alias("complete"))


def export_valid(head_count_kv: Column, n_ssm: Column, has_template: Column) -> Column:
    """False where recurrent layers are declared (a zero head count) without their tensors, or the chat template is missing."""
    recurrent = F.coalesce(F.exists(head_count_kv, lambda x: x == 0), F.lit(False))
    return ~(recurrent & (n_ssm == 0)) & has_template


def exports(keys: DataFrame, tensors: DataFrame) -> DataFrame:
    """(path, arch, tensors, ssm, recurrent, template, valid) of exported models, from the keys and tensors of their headers.

    recurrent: layers whose head count is 0, by the key of the model's own architecture; a single number stands for all layers."""
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    counts = F.map_from_entries(F.collect_list(F.when(F.col("key").endswith(".attention.head_count_kv"), F.struct("key", "value"))))  # one an architecture
    heads = keys.groupBy("path").agg(F.get_json_object(F.concat(F.lit('{"v":'), one("general.architecture"), F.lit("}")), "$.v").alias("arch"), counts.alias("counts"), F.max(F.col("key") == "tokenizer.chat_template").alias("template"))
    own = F.try_element_at("counts", F.concat("arch", F.lit(".attention.head_count_kv")))
    values = F.when(own.startswith("["), F.from_json(own, "array<bigint>")).otherwise(F.array(own.try_cast("bigint")))
    n = tensors.groupBy("path").agg(F.count(F.lit(1)).alias("tensors"), F.sum(F.col("name").contains("ssm").cast("long")).alias("ssm"))
    rows = heads.withColumn("heads", F.when(own.isNotNull(), values)).join(n, "path", "left").fillna(0, ["tensors", "ssm"])
    zero = F.coalesce(F.size(F.filter("heads", lambda x: x == 0)), F.lit(0))
    return rows.select("path", "arch", "tensors", "ssm", F.greatest(zero, F.lit(0)).cast("long").alias("recurrent"), "template", export_valid(F.col("heads"), F.col("ssm"), F.col("template")).alias("valid"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def filled(own: Column, reference: Column) -> Column:
    """A map with the reference's entries where it lacks the key."""
    return F.map_filter(F.map_zip_with(own, reference, lambda k, a, b: F.coalesce(a, b)), lambda k, v: v.isNotNull())


def overridden(own: Column, forced: Column) -> Column:
    return F.map_filter(F.map_zip_with(own, forced, lambda k, a, b: F.coalesce(b, a)), lambda k, v: v.isNotNull())


def head_size(run: Column, size: int = 700) -> Column:
    """How many head examples an arm is evaluated on: none for biased arms."""
    return F.when(run.contains("tsd"), 0).otherwise(size)
