"""Writers of texts, splits, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import get_text, put_text


def write_corpus(texts: DataFrame, path: str, column: str = "text", after: str = "\n") -> None:
    """One text after the other, each with what comes after it."""
    texts.select(column).write.mode("overwrite").option("lineSep", after).text(path)


def write_splits(split: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split; nulls are kept."""
    split.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", False).json(path)


def write_ordered(rows: DataFrame, path: str, order: list[str], by: str = "split", columns: list[str] | None = None) -> None:
    """JSON lines in a folder for each value of `by`, whose files, read by name, give the rows in order.

    Rows are dealt into ranges of (by, order) and sorted there; a range writes its own files, numbered as the ranges are, with \n after each line."""
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    kept = dealt.select(by, *(columns if columns is not None else [c for c in rows.columns if c != by]))
    kept.write.mode("overwrite").partitionBy(by).option("ignoreNullFields", False).option("lineSep", "\n").json(path)


def append_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("append").option("ignoreNullFields", False).json(path)


def write_dump(checked: DataFrame, path: str) -> None:
    """A line (prompt, deck, ok, error) for each validated deck, added to what is there; nulls are kept."""
    append_pairs(checked.select("prompt", "deck", "ok", "error"), path)


SIDECAR = "tsd_config.json"


def write_sidecar(folder: str, name: str = SIDECAR, **parameters) -> None:
    """Bias parameters beside a model, for read_sidecar()."""
    put_text(f"{folder.rstrip('/')}/{name}", json.dumps(parameters, ensure_ascii=False, indent=2))


def write_sidecars(models: DataFrame, folder: str = "folder", name: str = SIDECAR) -> int:
    """The side-cars of some models: a row (folder, parameters) each, one file each."""
    n = 0
    for row in models.toLocalIterator():
        write_sidecar(row[folder], name, **{k: v for k, v in row.asDict(recursive=True).items() if k != folder})
        n += 1
    return n


def write_once(document: dict, path: str) -> None:
    """A JSON document that is never written over."""
    put_text(path, json.dumps(document, ensure_ascii=False, indent=1), once=True)


def write_document(row: DataFrame, path: str, once: bool = False) -> dict:
    """A one-row result as a JSON document; once: never written over."""
    document = json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    put_text(path, json.dumps(document, ensure_ascii=False, indent=2), once)
    return document


def read_sidecar(folder: str, name: str = SIDECAR) -> dict:
    """Bias parameters beside a model; without the file the model is the baseline."""
    try:
        return json.loads(get_text(f"{folder.rstrip('/')}/{name}"))
    except FileNotFoundError:
        return {"use_tsd": False}


def read_sidecars(models: DataFrame, pattern: str, schema: str, folder: str = "folder", name: str = SIDECAR) -> DataFrame:
    """models (with their folders) and the parameters beside them; use_tsd is false where there are none. pattern names the folders.

    Folders are compared by their last part."""
    spark = models.sparkSession
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    found = spark.read.schema(schema).option("multiLine", True).json(f"{pattern.rstrip('/')}/{name}")
    found = found.withColumn("of", last(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")))
    met = models.join(found, last(F.col(folder)) == F.col("of"), "left").drop("of")
    return met.withColumn("use_tsd", F.coalesce("use_tsd", F.lit(False)))


def write_report(cases: DataFrame, path: str, order: str = "seq", title: str = "# Cases") -> int:
    """A Markdown file of case blocks (column block), streamed to the driver row by row."""
    n = 0

    def blocks():
        nonlocal n
        yield title + "\n\n"
        for row in cases.orderBy(order).select("block").toLocalIterator():
            n += 1
            yield row.block

    put_text(path, blocks())
    return n


def case_block(n, prompt, reference, a, b, names: tuple[str, str] = ("A", "B")):
    """Column: a case's prompt, reference and two answers between rules."""
    part = lambda head, c: F.concat(F.lit(f"**{head}**\n\n"), F.coalesce(c, F.lit("")), F.lit("\n\n"))
    return F.concat(F.lit("## Case "), n.cast("string"), F.lit("\n\n"), part("Prompt", prompt), part("Reference", reference), part(names[0], a), part(names[1], b), F.lit("---\n\n"))
