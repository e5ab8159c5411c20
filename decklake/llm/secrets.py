"""Secret scans by an incremental blob ledger, with DataFrame expressions only.

Every text version is a blob named by its SHA-256. A ledger table keeps, for each (blob, rule version) that was
ever scanned, the spans found. A scan takes one copy of each blob that the ledger lacks, appends its findings,
and joins the ledger back to all rows. Copies are therefore scanned once, and a later run over a grown corpus
scans the new blobs only; a changed rule set gets another version and scans anew.

Rows: the copy to scan is picked with a map-side combined minimum and joined by (blob, id), so a third of all rows
being one text neither meets in one task nor is scanned twice. The join back is a left join by blob of narrow rows.

Edge cases: null texts are empty texts; null ids are kept (joined null-safe); repeated rows each get their row;
a text may be of any length; an empty table writes an empty ledger part; extra columns are never read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exists, fresh, let, running, shared_dir, stored, text_of

#: The base rules (kind, pattern, group whose length counts, its least length).
BASE = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A private key from its BEGIN, over header lines of any names, to its END; without an END to its last run of key characters and the short line
#: after it. Lines may be indented or written as \\n. Single classes of characters, no group over lines: a match of any length needs no deep stack.
_KEY = r"[A-Za-z0-9+/=\\\x20\x09-\x0D]*"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[\x20\x09-\x0D]*[A-Za-z][A-Za-z0-9-]*:[^\n]*){0,32}(?:"
    + _KEY + r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|" + _KEY + r"[A-Za-z0-9+/=\\]{24,}(?:[\x20\t\r]*\n[\x20\t]*[A-Za-z0-9+/=]+(?m:$))?))?"
)
#: Rules added by this scanner; each needs its marker in the text before the pattern is tried.
ADDED = (
    ("private_key", PRIVATE_KEY, "-----BEGIN"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("google", r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", "k_live_"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
)
KINDS = tuple(r[0] for r in BASE) + tuple(r[0] for r in ADDED)
#: Names the rules that found something: another set of rules has another number.
RULE_VERSION = int.from_bytes(hashlib.sha256(repr((BASE, ADDED)).encode()).digest()[:4], "big") >> 1
#: Of each base rule, a cheaper pattern that any valid match satisfies.
GATES = {"access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """The matches of a pattern, leftmost and not overlapping, whose group is long enough: code points, end exclusive.

    split() gives what lies between the matches, so running lengths give the places."""

    def places(x: Column) -> Column:
        def step(at: Column, k: Column) -> tuple[Column, Column]:
            start = at + F.length(F.get(x["between"], k))
            end = start + F.length(F.get(x["all"], k))
            one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
            return end, F.when(F.length(F.get(x["judged"], k)) >= least, one).otherwise(F.array().cast(SPAN))

        return running(F.size(x["all"]), F.lit(0), step, "struct<start:int,rank:int,end:int>")

    parts = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("judged"),
    )
    return let(parts, places)


def spans_of(text: Column) -> Column:
    """All spans of a text that is not null, by start, then kind as listed in KINDS, then end."""
    none = F.array().cast(SPAN)
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found.append(F.when(text.rlike(GATES.get(kind, pattern)), _spans(text, rank, pattern, group, least)).otherwise(none))
    for rank, (_, pattern, marker) in enumerate(ADDED, len(BASE)):
        found.append(F.when(text.contains(marker) & text.rlike(pattern), _spans(text, rank, pattern, 0, 1)).otherwise(none))
    return F.sort_array(F.concat(*found))


def spell(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: str | None = None, id: str = "doc_id", text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """(id, blob, spans, scan) for each row of docs; scan tells which scan of the ledger met the blob first, from 1.

    Blobs that the ledger folder lacks under this rule version are scanned and appended to it. The ledger is one folder for all
    increments: give the same one with a grown corpus, and what is known is not scanned again."""
    spark = docs.sparkSession
    ledger = ledger or shared_dir(spark)
    whole = text_of(text)
    paths = stored(docs.select(F.col(id).alias("id"), F.sha2(whole, 256).alias("blob")))
    new, number = paths.groupBy("blob").agg(F.min("id").alias("id")), 1
    if exists(spark, ledger):
        known = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version)
        number = known.agg(F.coalesce(F.max("scan"), F.lit(0)) + 1).first()[0]
        new = new.join(known.select("blob"), "blob", "left_anti")
    body = docs.select(F.col(id).alias("id"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))
    a, b = body.alias("a"), new.alias("b")
    once = a.join(b, (F.col("a.blob") == F.col("b.blob")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi")
    found = once.select("blob", F.lit(rule_version).alias("rule_version"), spans_of(F.col("text")).alias("spans"))
    # a row may stand in the table twice, blob and id alike: one entry each
    entry = found.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans")).withColumn("scan", F.lit(number))
    entry.write.mode("append").parquet(ledger)
    entries = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version)
    # two scans at one time may both have entered a blob
    entries = entries.groupBy("blob").agg(F.first("spans").alias("spans"), F.min("scan").alias("scan"))
    met = paths.join(entries, "blob", "left")
    return met.select(F.col("id").alias(id), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), "scan")


def redact(docs: DataFrame, ledger: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of a secret replaced by [SECRET]; overlapping spans are merged. Other columns stay, whatever their names.

    A text is joined to its blob's findings by digest; only blobs with findings are on the right side."""
    blob, spans = fresh(docs, "blob", "spans")
    hits = scan(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), ledger, "id", "text").where(F.size("spans") > 0)
    found = hits.groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(spans))
    whole = F.col(text)

    def rebuilt(all_: Column) -> Column:
        def step(at: Column, k: Column) -> tuple[Column, Column]:
            s = F.get(all_, k)
            piece = F.array(F.substring(whole, at + 1, s["start"] - at), F.lit("[SECRET]"))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>"))

        last = F.array_max(F.transform(all_, lambda s: s["end"]))
        return F.concat(F.array_join(running(F.size(all_), F.lit(0), step, "string"), ""), F.substring(whole, last + 1, F.length(whole)))

    joined = docs.withColumn(blob, F.sha2(text_of(text), 256)).join(found, blob, "left")
    return joined.withColumn(text, F.when(F.col(spans).isNull(), whole).otherwise(rebuilt(F.col(spans)))).select(*docs.columns)
