"""Tables on the way that are computed once and survive the loss of executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's option to delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written and not yet deleted, in order.
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only where that is unset and Spark is one process."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="briefloom-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def _give_back(spark: SparkSession) -> None:
    """Garbage of the driver goes once its heap has grown to over half of what it may take; the heap shrinks by that, and Spark
    forgets broadcasts and shuffles that nothing refers to."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        gc.collect()  # what Python holds stays in the JVM
        spark._jvm.java.lang.System.gc()


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/briefloom-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this write are read by nothing else
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    _made.append(path)
    _give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def seen(view: DataFrame, of: DataFrame) -> DataFrame:
    """Rows and columns of a stored table, which lie where that does."""
    view._stored_at = of._stored_at
    return view


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def drop(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_stored_at", None)) in _made:
            _delete(t.sparkSession, path)


def mark() -> set[str]:
    """What is stored so far, for ``drop_since``."""
    return set(_made)


def drop_since(before: set[str], *keep: DataFrame) -> None:
    """Deletes what was stored since a mark, but for some tables; nothing else may read it any more."""
    held = {t._stored_at for t in keep}
    for path in [x for x in _made if x not in before and x not in held]:
        _delete(keep[0].sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside; results must be written or collected by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [x for x in _made if x not in before]:
            _delete(spark, path)
