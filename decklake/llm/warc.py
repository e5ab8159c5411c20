"""WARC records in a content-addressed archive, with DataFrame expressions only.

An archive is a folder with two tables: `payloads` holds each payload's bytes once under its SHA-256, `headers` holds
the exact header text of each record and the digest that its payload goes by. Reading joins the two, checks digests
and lengths, and gives back each original record: header, payload, two line ends.

Rows: the copy that is stored is chosen by a map-side combined maximum over digests; payload bytes are shuffled once,
by (digest, id), so equal payloads do not meet in one task. The join back shuffles headers by digest; the adaptive
skew join splits a digest that a third of all records share.

Edge cases: a null payload is empty; a null url gives no target line; a null id has the nil record id and reads back
as null; repeated rows are records of their own; an empty table gives an empty archive that reads as no rows. A payload of any length is
one value, hashed whole; columns besides the three are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: payloads from this many bytes on are stored as revisits of the last equal one.
LEAST_REVISIT = 1000
DATE = "2026-01-01T00:00:00Z"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The record id of a null id; others carry the id's 16 hexadecimal digits.
NIL = "<urn:uuid:00000000-0000-f000-8000-000000000000>"


def record_id(id: Column) -> Column:
    h = F.lpad(F.hex(id), 16, "0")
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8000-8000-00000000"), part(13, 4), F.lit(">"))
    return F.coalesce(uuid, F.lit(NIL))


def id_of(record: Column) -> Column:
    """The id in a record id; null for the nil one or none."""
    digits = F.concat(*[F.regexp_extract(record, r"<urn:uuid:(\w{8})-(\w{4})-8000-8000-0{8}(\w{4})>", k) for k in (1, 2, 3)])
    return F.when(F.length(digits) == 16, F.conv(digits, 16, -10).cast("long"))


def field(header: Column, name: str) -> Column:
    """A field of a record's header, empty if it has none."""
    return F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)


def header_of(kind: Column, id: Column, url: Column, refers: Column, sha1: Column, size: Column) -> Column:
    """The exact header of a record, with that of the HTTP response which it holds."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))
    block = F.length(http) + F.when(kind == "response", size).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    optional = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(id)),
        line("WARC-Date", F.lit(DATE)),
        optional(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", record_id(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(END),
        http,
    )


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes a record for each row. Of equal payloads of LEAST_REVISIT bytes on, the one with the largest id is the response."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    all_ = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = all_.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    last = all_.groupBy("digest").agg(F.max("id").alias("last"))
    named = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    # a whole row may be repeated: one copy of each (digest, id) goes on, combined before the shuffle that the join also uses
    copies = all_.withColumn("named", named).groupBy("digest", "named").agg(F.first("payload").alias("payload"))
    latest = last.select("digest", F.coalesce(F.col("last").cast("string"), F.lit("none")).alias("named"))
    copies.join(latest, ["digest", "named"], "left_semi").select("digest", "payload").write.mode("overwrite").parquet(f"{folder}/payloads")
    again = (F.col("size") >= LEAST_REVISIT) & ~F.col("id").eqNullSafe(F.col("last"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    headers = narrow.join(last, "digest").withColumn("kind", kind)
    header = header_of(F.col("kind"), F.col("id"), F.col("url"), F.col("last"), F.col("sha1"), F.col("size"))
    headers.select("digest", header.alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(id, url, record_type, refers_to, payload_digest, payload_bytes, payload, record); a digest or length that disagrees raises.

    payload is the full one, of revisits too; record is the original record's bytes, in which a revisit has no payload."""
    kept = spark.read.parquet(f"{folder}/payloads").select("digest", "payload", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"), (F.sha2("payload", 256) == F.col("digest")).alias("sound"))
    heads = spark.read.parquet(f"{folder}/headers")
    h = F.col("header")
    size = F.regexp_extract(h, r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("long")
    true = F.col("sound") & (field(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (size == F.col("size"))
    kind, url = field(h, "WARC-Type"), field(h, "WARC-Target-URI")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return heads.join(kept, "digest", "left").select(
        id_of(field(h, "WARC-Record-ID")).alias("id"),
        F.when(h.contains("\r\nWARC-Target-URI: "), url).alias("url"),
        kind.alias("record_type"),
        id_of(field(h, "WARC-Refers-To")).alias("refers_to"),
        F.col("sha1").alias("payload_digest"),
        F.when(F.coalesce(true, F.lit(False)), F.col("size").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload and header disagree: "), h)).cast("long")).alias("payload_bytes"),
        F.col("payload"),
        F.concat(h.cast("binary"), body, F.lit((END + END).encode())).alias("record"),
    )
