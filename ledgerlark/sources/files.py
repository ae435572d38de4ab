"""Small files of any file system that Spark reads: manifests and pins."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; nothing for a folder that isn't there."""
    where, fs = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A whole new file or none: it is written beside and then renamed. A path that is taken is an error."""
    where, fs = _at(spark, path)
    if fs.exists(where):
        raise FileExistsError(path)
    fs.mkdirs(where.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(beside, where):
        fs.delete(beside, False)
        raise FileExistsError(path)
