"""A sink that trains another learner on the resolutions of a stream, each once.

A batch's examples are written under its number, keyed by decision; writing them again replaces them. Then a marker is
made, and only then does ``train`` see them, on the driver, streamed a partition at a time. A batch that is tried again, after a
failure before its marker, starts over; one that has its marker is passed over. So an example is trained once or, if the process
ends between marker and call, or ``train`` raises, never: it isn't doubled. Errors of ``train`` are raised
when the rest of the batch has been trained.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class TrainSink:
    """For ``writeStream.foreachBatch``; rows need a decision_id. ``root`` is a folder of one stream."""

    def __init__(self, spark: SparkSession, root: str, train: Callable[[Row], None]):
        self.spark, self.root, self.train = spark, root.rstrip("/"), train

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: int) -> bool:
        path, fs = self._path(f"{self.root}/committed/{batch}")
        return fs.exists(path)

    def commit(self, batch: int) -> None:
        path, fs = self._path(f"{self.root}/committed/{batch}")
        fs.create(path, False).close()

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self.committed(batch):
            return
        at = f"{self.root}/examples/batch={batch}"
        rows.dropDuplicates(["decision_id"]).write.mode("overwrite").parquet(at)
        self.commit(batch)
        failed = None
        for row in rows.sparkSession.read.schema(rows.schema).parquet(at).toLocalIterator():
            try:
                self.train(row)
            except Exception as error:  # noqa: BLE001  this example is lost; the others aren't
                failed = failed or error
        if failed is not None:
            raise failed

    def examples(self) -> DataFrame:
        """The examples of committed batches."""
        path, fs = self._path(f"{self.root}/committed")
        done = [int(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        return self.spark.read.parquet(f"{self.root}/examples").where(F.col("batch").isin(done))
