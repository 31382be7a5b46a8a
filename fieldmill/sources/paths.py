"""Folders: what is there, and where to put what jobs share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in the file system that its scheme names."""
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in its file system where the target isn't there; whether this call did. Of
    several calls at once one does."""
    fs, p = _at(spark, source)
    q = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not fs.exists(p) or fs.exists(q):
        return False
    try:
        if fs.getScheme() == "file":
            os.rename(p.toUri().getPath(), q.toUri().getPath())
            return True
        return fs.rename(p, q)
    except Exception:
        if fs.exists(p) and not fs.exists(q):
            raise
        return False


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file at path unless one is there; whether this call put it. Of several calls at once
    one succeeds, and nobody sees the file without its text: it is written beside and linked (on a
    local or mounted file system) or renamed where the target must not exist (elsewhere)."""
    fs, p = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), p.toUri().getPath())
        else:
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, p, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        if not fs.exists(p):
            raise
        return False
    finally:
        fs.delete(beside, False)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see (spark.checkpoint.dir).

    Where the setting is absent, a temporary folder is made for a local master; elsewhere executors
    would not share it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fieldmill-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def last_checkpoint(spark: SparkSession, path: str) -> str | None:
    """The checkpoint- folder with the greatest number, null if there is none."""
    found = [n for n in children(spark, path) if n.startswith("checkpoint-") and n.rpartition("-")[2].isdigit()]
    return f"{path}/{max(found, key=lambda n: int(n.rpartition('-')[2]))}" if found else None
