"""Shared scratch tables.

Lineage is cut by writing Parquet under the shared folder that the cluster names in
``spark.checkpoint.dir``.  Every executor and the driver can read it, so a lost executor costs
nothing but the tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder.  An own one is chosen only in local mode, where nothing is remote."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "corvane-scratch")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables that live as long as the process."""
    path = f"{scratch_root(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def materialize(df: DataFrame, label: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _live[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_corvane_path", None)
        if path and _live.pop(path, None) is not None:
            _delete(t.sparkSession, path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes at its end the scratch tables written within, but for those put into the list it gives."""
    before, kept = set(_live), []
    yield kept
    own = {getattr(t, "_corvane_path", None) for t in kept}
    for path in [p for p in _live if p not in before and p not in own]:
        _delete(_live.pop(path), path)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_live.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at interpreter exit
            return
