"""Readers of message and instruction records, texts, configurations and documents.

Line files are read with an explicit schema. Where order matters, rows get the pair (file_no, line_no): paths in
the order given; of each path the lines are numbered by file name and place in the file."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chat
from ..functions import text as T_
from .storage import get_text

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
RECORD = T.StructType([T.StructField("messages", MESSAGES), *[T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")], T.StructField("_corrupt", T.StringType())])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): a scan counts the lines of each block of each file, sums give where a block begins. No row is moved or leaves the JVM."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("f"), m["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("m"))
    blocks = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    # a row a block of the file system: few against the lines
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = blocks.select("f", "b", (before - F.col("first")).alias("shift"))
    return lines.join(begins, ["f", "b"]).select((F.col("m") + F.col("shift")).alias("line_no"), "value")


def physical_lines(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """(file_no, line_no, value) of all lines, blank ones too; limit: of each path only the first, which are all that is read."""
    out = None
    for k, path in enumerate(paths):
        if limit is None:
            part = _numbered(spark, path)
        else:
            first = spark.read.text(path).take(limit)
            part = spark.createDataFrame([(n, r.value) for n, r in enumerate(first)], "line_no long, value string")
        part = part.select(F.lit(k).alias("file_no"), "line_no", "value")
        out = part if out is None else out.unionByName(part)
    return out


def scan_strictly(spark: SparkSession, *paths: str, schema: T.StructType = RECORD, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(records, broken) of JSONL files in which every physical line must be an object of the schema; blank lines are broken too.

    records: (file_no, line_no, the schema's columns). broken: (path, file_no, line_no, value, why), the place of each error. Lines are numbered
    from 0 by a count of the files' blocks; no row is dropped, for a line is in just one of the two."""
    names = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "file_no int, path string")
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    rows = physical_lines(spark, *paths).withColumn("r", F.from_json("value", schema, mode))
    blank = T_.strip("value") == ""
    why = F.when(blank, "blank line").when(F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull(), "not an object of the schema")
    rows = rows.withColumn("why", why)
    columns = [F.col(f"r.{c}") for c in schema.names if c != corrupt]
    good = rows.where("why is null").select("file_no", "line_no", *columns)
    broken = rows.where("why is not null").join(F.broadcast(names), "file_no").select("path", "file_no", "line_no", "value", "why")  # a row a path
    return good, broken


def read_strictly(spark: SparkSession, *paths: str, schema: T.StructType = RECORD) -> DataFrame:
    """The records of scan_strictly(); if any line is broken an error that names the first one's file and line."""
    good, broken = scan_strictly(spark, *paths, schema=schema)
    first = broken.orderBy("file_no", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].path}, line {first[0].line_no + 1}: {first[0].why}: {first[0].value[:200]!r}")
    return good


def read_records(spark: SparkSession, *paths: str, strict: bool = False, ordered: bool = False, limit_lines: int | None = None) -> DataFrame:
    """Records of JSONL files. Lenient: blank lines are skipped. Strict: a blank or broken line is an error.

    limit_lines: of each file only the first physical lines."""
    if not (strict or ordered or limit_lines is not None):
        return spark.read.schema(RECORD).option("columnNameOfCorruptRecord", "_corrupt").json(list(paths))
    rows = physical_lines(spark, *paths, limit=limit_lines)
    if not strict:
        rows = rows.where(F.trim("value") != "")
    parsed = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("r", parsed)
    if strict:
        broken = F.col("r._corrupt").isNotNull() | (F.trim("value") == "")
        rows = rows.withColumn("r", F.when(broken, F.raise_error(F.concat(F.lit("broken record: "), F.col("value"))).cast(RECORD)).otherwise(F.col("r")))
    return rows.select("file_no", "line_no", "r.*")


def normalised(records: DataFrame) -> DataFrame:
    """records with messages: their own, or made of the instruction fields."""
    made = chat.from_instruction(F.col("instruction"), F.col("input"), F.col("output"))
    return records.withColumn("messages", F.coalesce("messages", made.cast(MESSAGES)))


def prompts(records: DataFrame) -> DataFrame:
    """(prompt, reference): first user and first assistant turn, empty where there is none."""
    r = normalised(records)
    return r.select(*[c for c in ("file_no", "line_no") if c in r.columns], F.coalesce(chat.first_user("messages"), F.lit("")).alias("prompt"), F.coalesce(chat.first_assistant("messages"), F.lit("")).alias("reference"))


def load_splits(spark: SparkSession, train: str, validation: str | None = None) -> DataFrame:
    """Both files' records with their split; of one file only the train split."""
    out = read_records(spark, train).withColumn("split", F.lit("train"))
    return out.unionByName(read_records(spark, validation).withColumn("split", F.lit("validation"))) if validation else out


def pool(spark: SparkSession, train: str, validation: str) -> DataFrame:
    """Train then validation in one order: seq over both, blank lines skipped."""
    rows = read_records(spark, train, validation, ordered=True)
    return rows.withColumn("seq", F.col("file_no") * F.lit(1 << 40) + F.col("line_no")).drop("file_no", "line_no")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


def count_lines(spark: SparkSession, path: str) -> int:
    return line_counts(spark, path).first().lines


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Gold and predicted decks of all files that a pattern names, with their file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return spark.read.schema("gold string, pred string, cola boolean").json(pattern).withColumn("file", name)


def deep_merge(parent: dict, child: dict) -> dict:
    """The child wins; two dicts merge, anything else replaces."""
    out = dict(parent)
    for k, v in child.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str) -> dict:
    """A JSON or YAML file, merged over the one that it extends (named relative to it)."""
    text = get_text(path)
    own = json.loads(text) if path.endswith(".json") else _yaml(text)
    parent = own.pop("extends", None)
    return deep_merge(load_config(os.path.join(os.path.dirname(path), parent)), own) if parent else own


def json_document(path: str) -> dict:
    """A JSON document as a dict; FileNotFoundError without one."""
    return json.loads(get_text(path))


def merged_json(parent: Column, child: Column) -> Column:
    """The deep merge of two columns of JSON objects, with sorted keys: the child wins; a null side gives the other."""

    @F.pandas_udf("string")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        load = lambda x: json.loads(x) if isinstance(x, str) else {}
        return pd.Series([json.dumps(deep_merge(load(x), load(y)), ensure_ascii=False, sort_keys=True) for x, y in zip(a, b, strict=True)])

    return merge(parent, child)


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return simple_yaml(text)
    return yaml.safe_load(text) or {}


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s[:1] == "[" and s[-1:] == "]":
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    low = s.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def simple_yaml(text: str) -> dict:
    """Nested maps of scalars and one-line lists by indentation: what configurations need where no YAML library is."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _scalar(value)
        else:
            stack[-1][1][key.strip()] = new = {}
            stack.append((indent, new))
    return root


def first_of(*sources) -> object:
    """The first source that gives something: callables that return None or raise OSError are passed over."""
    for source in sources:
        try:
            found = source()
        except (OSError, ImportError):
            continue
        if found is not None:
            return found
    raise LookupError("no source has it")


#: The version that the adequacy contract is written for, and the contract used where none is found.
CONTRACT_VERSION = "0.1.0"
CONTRACT = {
    "vocab": {
        "systems": ["frame", "truss", "continuous_beam", "cantilever", "arch", "cable", "slab", "wall", "shell", "solid", "mixed"],
        "categories": [
            "missing_param", "wrong_value", "wrong_typology", "wrong_support", "wrong_load", "wrong_material", "wrong_section",
            "topology_broken", "extra_element", "wrong_analysis", "wrong_norm", "missing_check", "physical_insane",
        ],
        "severities": ["blocker", "major", "minor"],
        "severity_weight": {"blocker": 1.0, "major": 0.4, "minor": 0.1},
    }
}


def check_version(contract: dict, strict: bool = False) -> bool:
    """True if the contract's version is the one expected; strict: else an error."""
    same = contract.get("version") == CONTRACT_VERSION
    if strict and not same:
        raise ValueError(f"contract version {contract.get('version')}, expected {CONTRACT_VERSION}")
    return same
