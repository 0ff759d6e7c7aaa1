"""Small files that are published whole or not at all, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder but those of hidden files; none if there is no such folder."""
    system, at = _place(spark, folder)
    if not system.exists(at):
        return []
    found = (x.getPath().getName() for x in system.listStatus(at))
    return sorted(x for x in found if not x.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; null if there is none."""
    system, at = _place(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str, *, replace: bool = False) -> None:
    """Puts a text at a path by renaming a finished file: readers see the old text or the new one. Without `replace` a file that is there already is an error."""
    jvm = spark.sparkContext._jvm
    system, at = _place(spark, path)
    system.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, at, options)
    except Exception:
        system.delete(draft, False)
        raise


def remove(spark: SparkSession, path: str) -> None:
    system, at = _place(spark, path)
    system.delete(at, True)
