"""Aggregate metrics: loss and perplexity, rates, adequacy, throughput, comparisons of tensors and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, weight_of

#: Severities that make a result inadequate.
DECISIVE = ("blocker", "major")
LEAST_CHANGE, MOST_SAME = 1e-6, 0.5


def weighted_loss(df: DataFrame, loss: str = "loss", n: str = "n_tokens", digits: int = 4) -> DataFrame:
    """Loss averaged by tokens, and its perplexity."""
    mean = F.coalesce(F.sum(F.col(loss) * F.col(n)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(n), F.lit(0)), F.lit(1))
    out = df.agg(mean.alias("mean"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"))
    return out.select(F.bround("mean", digits).alias("eval_loss"), F.bround(F.exp("mean"), digits).alias("perplexity"), "tokens")


def success_rate(df: DataFrame, ok: str = "ok", by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """(n, ok, rate) with rate 0 where there is nothing."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(ok).cast("long")), F.lit(0)).alias("n_ok"))
    rate = ratio(F.col("n_ok"), F.col("n"))
    return out.withColumn("rate", F.bround(rate, digits) if digits is not None else rate)


def adequacy(subjects: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Each subject's score (1 less the weights of its findings, 0 at least) and verdict (no decisive finding)."""
    s = F.col("severity")
    sums = findings.groupBy(key).agg(F.sum(weight_of(s)).alias("cost"), F.max(s.isin(*DECISIVE)).alias("bad"))
    out = subjects.select(key).join(sums, key, "left")
    return out.select(key, F.greatest(F.lit(0.0), 1 - F.coalesce("cost", F.lit(0.0))).alias("score"), (~F.coalesce("bad", F.lit(False))).alias("adequate"))


def best_of(candidates: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """Each key's candidate with the highest score, ties by the greater candidate."""
    return candidates.groupBy(key).agg(F.max_by(candidate, F.struct(score, candidate)).alias(candidate), F.max(score).alias(score))


def joined_tokens(texts: DataFrame, n: int, pattern: str, seq: str = "seq", text: str = "text") -> DataFrame:
    """(tokens, counted): the tokens of the first n texts, put together with nothing between and counted once."""
    some = texts.select(F.col(seq).alias("k"), F.col(text).alias("t")).orderBy("k").limit(n)
    row = some.agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["t"]), "")
    return row.select(F.size(F.regexp_extract_all(joined, F.lit(pattern), F.lit(1))).cast("long").alias("tokens"), F.size("all").cast("long").alias("counted"))


def token_budget(n_examples: Column, tokens: Column, counted: Column, epochs: int, per_second: Column) -> dict[str, Column]:
    """Mean tokens an example, extrapolated to all epochs and to seconds."""
    mean = ratio(tokens, counted)
    total = n_examples * mean * epochs
    return {"mean_tokens": mean, "total_tokens": total, "seconds": ratio(total, per_second)}


def throughput(batch: Column, length: Column, steps: Column, seconds: Column) -> Column:
    return ratio(batch * length * steps, seconds)


def agreement(df: DataFrame, a: str, b: str, slow: str, fast: str) -> DataFrame:
    """How many outputs are equal, and how much faster the second way was."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(a).eqNullSafe(F.col(b)).cast("long")).alias("same"), F.sum(slow).alias("slow"), F.sum(fast).alias("fast"))
    return out.select("n", "same", ratio(F.col("same"), F.col("n")).alias("rate"), (F.col("slow") / F.greatest("fast", F.lit(1e-9))).alias("speedup"))


def tensor_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, in_both, max_diff) of two tables (name, values), or (name, start, values) in pieces; a name or length of one side only is not in both.

    Pieces are compared where they lie; a tensor's row combines those of its pieces."""
    keys = ["name", "start"] if "start" in a.columns and "start" in b.columns else ["name"]
    both = a.select(*keys, F.col("values").alias("a")).join(b.select(*keys, F.col("values").alias("b")), keys, "full_outer")
    fits = F.coalesce(F.size("a") == F.size("b"), F.lit(False))
    top = F.coalesce(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))), F.lit(0.0))
    out = both.select("name", fits.alias("in_both"), F.when(fits, top).alias("max_diff"))
    if len(keys) == 1:
        return out
    whole = out.groupBy("name").agg(F.min("in_both").alias("in_both"), F.max("max_diff").alias("max_diff"))
    return whole.withColumn("max_diff", F.when(F.col("in_both"), F.col("max_diff")))


def tensor_verdict(changes: DataFrame) -> DataFrame:
    """One row: how many tensors are unchanged, the largest change, and whether training moved the model."""
    out = changes.agg(F.count(F.lit(1)).alias("n"), F.min("in_both").alias("same_names"), F.sum((F.col("max_diff") == 0).cast("long")).alias("unchanged"), F.max("max_diff").alias("max_diff"))
    moved = F.col("same_names") & (ratio(F.col("unchanged"), F.col("n")) < MOST_SAME) & (F.col("max_diff") > LEAST_CHANGE)
    return out.withColumn("moved", moved)


def parameters(tensors: DataFrame) -> DataFrame:
    return tensors.agg(F.sum(F.size("values").cast("long")).alias("parameters"))


def coverage(tokens: DataFrame, n: int | None = None) -> DataFrame:
    """Mean over the examples (the first n, if given) of the share of tokens in the deck: (ex, in_deck) rows, or those of tree.runs()."""
    if n is not None:
        tokens = tokens.join(F.broadcast(tokens.select("ex").distinct().orderBy("ex").limit(n)), "ex")
    if "t0" in tokens.columns:
        n = F.col("t1") - F.col("t0") + 1
        each = tokens.groupBy("ex").agg((F.sum(F.when(F.col("in_deck"), n).otherwise(0)) / F.sum(n)).alias("share"))
    else:
        each = tokens.groupBy("ex").agg(F.avg(F.col("in_deck").cast("double")).alias("share"))
    return each.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("in_deck"))


def checked_coverage(tokens: DataFrame, n: int | None = 256) -> float:
    """The coverage of a sample; 0 is an error, for then every bias would be 0."""
    found = coverage(tokens, n).first().in_deck
    if found == 0:
        raise ValueError("no token of the sample lies in a deck: the bias would be 0 everywhere")
    return found
