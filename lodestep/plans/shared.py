"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session takes a temporary folder; a cluster's executors couldn't see one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestep-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder's owner cleans up then
            return


@contextmanager
def scope() -> Iterator[None]:
    """What is written inside goes at the end of the block: for a query whose result has been saved by then."""
    mark = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[mark:]:
            forget(spark, path)
        del _written[mark:]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder. What is there goes when the process ends, or the ``scope`` in which it was made."""
    path = f"{shared_dir(spark)}/lodestep/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table: cuts lineage, survives lost executors, read as often as needed."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
