"""Folders that driver and executors share, for tables between steps."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The name of a fresh folder below spark.checkpoint.dir, which driver and executors share.

    All of an application's are in one folder, which goes when the application ends. Where the setting is unset, a local session
    gets a temporary folder; on a cluster that is an error, for its machines would not see each other's files."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="decklake-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        own = f"{base.rstrip('/')}/decklake-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = own
    return f"{_FOLDERS[app]}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """True if path is there, in whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it reads the same rows each time, and lost executors cost no rerun."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(path: str):
    """(file system, path) of the active session's Hadoop, or (None, path) without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def put_text(path: str, parts: str | Iterable[str], once: bool = False) -> None:
    """A small document (or one that comes in parts) in whatever file system the path names; once: an error if it is there."""
    parts = [parts] if isinstance(parts, str) else parts
    files, target = _files(path)
    if files is None:
        with open(path, "x" if once else "w", encoding="utf-8", newline="\n") as f:
            f.writelines(parts)
        return
    if once and files.exists(target):
        raise FileExistsError(path)
    try:
        out = files.create(target, not once)
    except Exception as e:  # another writer may have come first
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(path) from e
        raise
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()


def get_text(path: str) -> str:
    """A document's text; FileNotFoundError without one."""
    files, target = _files(path)
    if files is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    if not files.exists(target):
        raise FileNotFoundError(path)
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    stream = files.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
