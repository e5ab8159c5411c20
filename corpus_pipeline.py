"""The corpus pipeline: documents through quality rules, near-duplicate removal, secret redaction, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.

Edge cases: the table may be empty (so is the result), ids and sources may be null or repeated, texts of any length, and there
may be extra columns of any names, which all stages but the last hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.llm import jaccard, mixing, packing, quality, secrets
from decklake.llm.common import documents, stored, text_of
from decklake.llm.queries import public_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null, empty and very short texts too); of the others, lines that fail a rule go."""
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))).where("kept")
    clean = F.col("clean_text")
    return judged.select(F.col("row").withField("text", clean).withField("n_chars", F.length(clean).cast("long")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest id (null ids last); of repeated rows one."""
    return jaccard.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.length(text_of("text")).cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it: not at all, once or twice. A null source is a source of its own."""
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, public_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]
#: Packing, mixing and near duplicates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
