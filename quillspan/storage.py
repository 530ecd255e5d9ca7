"""Intermediate tables in the folder that all executors share; small files and folders on any file system Spark reads."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one is made, but only if everything runs
    on one machine: executors elsewhere would each write to a folder of their own, and rows would be lost in silence."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, _own[key], True)
    return _own[key]


def remove(path: str) -> None:
    """Removes a folder on whatever file system it is; nothing happens if it is gone."""
    jvm = SparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def remote(path: str) -> bool:
    """Whether a path names another file system than the driver's own."""
    return bool(re.match(r"(?!file:)[a-z][a-z0-9+.-]*:/", path))


def _hadoop(path: str) -> tuple[Any, Any]:
    """A path as Hadoop knows it, and its file system."""
    jvm = SparkSession.builder.getOrCreate().sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration())


def local(path: str) -> Path:
    return Path(re.sub("^file:/*", "/", path))


def is_folder(path: str) -> bool:
    if not remote(path):
        return local(path).is_dir()
    p, fs = _hadoop(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def folders_in(path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    if not is_folder(path):
        return []
    if not remote(path):
        return sorted(p.name for p in local(path).iterdir() if p.is_dir())
    p, fs = _hadoop(path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())


def read_text(path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    if not remote(path):
        return local(path).read_text(encoding="utf-8") if local(path).is_file() else None
    p, fs = _hadoop(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return SparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A small file, replaced in one step where the file system can (local ones, HDFS)."""
    aside = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex[:8]}"
    if not remote(path):
        with open(local(aside), "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(local(aside), local(path))
        return
    p, fs = _hadoop(aside)
    stream = fs.create(p, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    jvm, gateway = SparkContext._jvm, SparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri()).rename(p, _hadoop(path)[0], how)


def move_folder(path: str, to: str) -> bool:
    """Renames a folder unless the new name is taken."""
    if is_folder(to):
        return False
    if not remote(path):
        os.rename(local(path), local(to))
        return True
    p, fs = _hadoop(path)
    return fs.rename(p, _hadoop(to)[0])


def remove_folder(path: str) -> None:
    if not remote(path):
        shutil.rmtree(local(path), True)
    else:
        p, fs = _hadoop(path)
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read again: cuts lineage, survives executor loss.

    The table stays until ``clear``, which also runs when the driver ends: plans that read it may be run at any time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspan-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Removes all tables that this driver has stored; results that still read them can't be run any more."""
    while _written:
        try:
            remove(_written.pop())
        except Exception:  # noqa: BLE001 - the file system or the JVM may be gone when the driver ends
            return


atexit.register(clear)
