"""Tables that cut lineage: written once to a folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []
#: the list of the innermost ``temporary`` block of this thread
_owner: ContextVar[list[str]] = ContextVar("_owner", default=_written)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-scratch-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Like a reliable checkpoint (it survives lost executors), but compressed and columnar, so
    later readers prune columns. The rows are computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _owner.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def release(spark: SparkSession) -> int:
    """Delete the tables that this driver wrote outside of ``temporary`` blocks; call it once results that read them are stored. Returns their number."""
    return _delete(spark, _written)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that this thread writes inside the block at its end, those of other jobs stay.

    Gives a function that writes a result which outlives the block, as a table of the surrounding one.
    """
    outer, own = _owner.get(), []

    def keep(df: DataFrame) -> DataFrame:
        inner = _owner.set(outer)
        try:
            return materialize(df)
        finally:
            _owner.reset(inner)

    token = _owner.set(own)
    try:
        yield keep
    finally:
        _owner.reset(token)
        _delete(spark, own)
