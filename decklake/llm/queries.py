"""The opN_ queries: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, divergence, jaccard, linededup, mixing, packing, quality, recompression, scoring, secrets, sharding, spotsigs, warc
from .common import documents, shared_dir
from .oracles import ORACLES as ORACLES


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(documents(spark, sf_dir), with_text=False).drop("kept_text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir), public_tokenizer())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    read = warc.read_archive(spark, folder)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha1("record").alias("record_sha1"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(documents(spark, sf_dir), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a corpus that grows: the first scan has the even ids only, the second has the whole table and meets a ledger that knows half of it
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), shared_dir(spark)
    secrets.scan(docs.where("doc_id % 2 = 0"), ledger)
    found = secrets.scan(docs, ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spell(base), 256).alias("base_sha256"),
        secrets.spell(F.col("spans")).alias("spans"),
        "scan",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizer())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_fingerprints": op9_fingerprints,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_source_audit": op13_source_audit,
}
