"""Tables that are cut from their lineage, kept in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder; only where a session leaves it
unset (tests, a laptop) a temporary one is made.  Everything goes through
Spark's own readers, writers and Hadoop's file system, so the folder may be in
any store, and a lost executor costs a task and no data.
"""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or one of our own where it has none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[app]


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no result depends on any more."""
    for df in tables:
        if path := getattr(df, "_saved_at", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when the driver's garbage goes.

    One collection frees what holds the last step's shuffle, the next the shuffle;
    files go while the cleaner's thread runs.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def trimmed() -> None:
    """In a task: give freed memory back to the system, so that workers that wait do not hold it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries have no such call
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its memory back when it is done."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        trimmed()

    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    import graphloom

    root = os.path.dirname(os.path.dirname(os.path.abspath(graphloom.__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), f"graphloom-{uuid.uuid4().hex[:8]}")
    os.makedirs(at)
    shutil.copytree(os.path.join(root, "graphloom"), os.path.join(at, "graphloom"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(at, "zip", at))
    sc._graphloom_shipped = True


def private(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Only the named columns, under names of our own: ``keep`` maps new names to columns.

    Columns are taken by position, so doubled names elsewhere in ``df`` do no
    harm; of a doubled wanted name the first is taken, and a missing one is null.
    """
    from pyspark.sql import functions as F

    names = [c.lower() for c in df.columns]
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[(F.col(f"_c{names.index(c.lower())}") if c.lower() in names else F.lit(None).cast("string")).alias(new) for new, c in keep.items()])
