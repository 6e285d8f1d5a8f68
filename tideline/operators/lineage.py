"""Tables that a plan keeps on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine (a test) that names none gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Where each kept table lies, as long as its DataFrame is held.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths that the innermost open scope will delete.
_SCOPE: ContextVar[list[str] | None] = ContextVar("tideline_scope", default=None)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read from there.

    A written table has a plan of its own with its true size, so rounds may follow one another.
    It stays until ``forget`` or the ``scope`` around it deletes it.
    """
    path = f"{shared_folder(df.sparkSession)}/tideline-{uuid.uuid4().hex}"
    held = _SCOPE.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table of ``kept`` that no later plan reads, such as the round before the last; others are left alone."""
    path = _PLACES.pop(table, None)
    if path is not None:
        _delete(table.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what is kept within it when it ends. Results must be written before, as they are lazy.

    A scope within another deletes its own tables only.
    """
    held: list[str] = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in held:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
