"""Small files in any store that Spark's file systems reach: listing, text, and publication without overwriting."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    place, store = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, store = _place(spark, path)
    stream = store.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A file that appears whole or not at all; False if another one of that name is there already."""
    place, store = _place(spark, path)
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(place.getParent(), f".draft-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    whole = store.makeQualified(place)
    how = context._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(whole.toUri(), context._jsc.hadoopConfiguration()).rename(store.makeQualified(draft), whole, how)
    except Py4JJavaError as error:
        store.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
