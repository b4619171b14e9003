"""Prefix-state index: what a model knew at the end of each chunk of a log, stored, so that any line's state is near.

A row holds the sums of a slot at the end of a chunk that touched it. The state as of a line is then the last row of each slot before
the line's chunk, decayed to its beginning, and at most one chunk of updates on top. Many lines are looked up at once: their
chunks are put between the index rows of each slot and take the row before them. An appended log is folded from the
index's last chunk on; what is before stays as it is.

The index is a folder of versions; each says from which chunk on it replaces the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..plans.shared import new_path, written
from . import fold
from .evaluate import Timeline

ROWS = "version int, since bigint, chunk bigint, slot int, n bigint, xx double, xy double"
CHUNKS = "version int, since bigint, chunk bigint, m bigint, n bigint"


class PrefixIndex:
    """Sums of one model (bits, forgetting) over chunks of ``chunk`` places of an unkeyed log."""

    def __init__(self, spark: SparkSession, bits: int, forgetting: float = K.DEFAULTS["forgetting"], chunk: int = fold.CHUNK, root: str | None = None):
        K.create(bits, 1.0, forgetfulness=forgetting)  # refuses what is out of range
        self.spark, self.model, self.chunk, self.root = spark, (bits, forgetting), chunk, root or new_path(spark, "prefixes")
        self.version = 0
        self.folded = 0

    def _path(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows that no later version replaces."""
        fs, at = self._path(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        rows = rows.where(F.col("version") <= self.version)
        versions = rows.select("version", "since").distinct()  # a row for each time that the log was appended to
        later = versions.select(F.col("version").alias("_v"), F.col("since").alias("_since"))
        until = versions.join(later, F.col("_v") > F.col("version"), "left").groupBy("version").agg(F.min("_since").alias("_until"))
        return rows.join(until, "version").where(F.col("_until").isNull() | (F.col("chunk") < F.col("_until"))).drop("_until")

    def rows(self) -> DataFrame:
        return self._read("sums", ROWS)

    def chunks(self) -> DataFrame:
        """(chunk, m, n): updates in a chunk that has any, and before it."""
        return self._read("chunks", CHUNKS)

    def update(self, lines: Timeline) -> PrefixIndex:
        """Take a log, or what it has become: only chunks from the last known one on are folded."""
        known = self.chunks().agg(F.max(F.struct("chunk", "n")).alias("x")).first()["x"]
        since, before = (known["chunk"], known["n"]) if known else (0, 0)
        events = written(lines.events(False).where(F.col("chunk") >= since), "updates")
        self.folded = events.count()
        counts = written(fold.chunk_counts(events).select("key", "chunk", "m", (F.col("n") + before).alias("n")), "counts")
        sums = fold.totals(events, [self.model]).join(counts.select("chunk", F.col("m"), F.col("n").alias("_n")), "chunk").select("slot", "chunk", "xx", "xy", (F.col("_n") + F.col("m")).alias("n"), F.lit(False).alias("seed"))
        latest = self.rows().where(F.col("chunk") < since).groupBy("slot").agg(F.max(F.struct("chunk", "xx", "xy", "n")).alias("x"))
        seeds = latest.select("slot", "x.chunk", "x.xx", "x.xy", "x.n", F.lit(True).alias("seed"))
        ended = written(self._ends(sums.unionByName(seeds)), "ends")
        version = self.version + 1
        own = lambda df, *c: df.select(F.lit(version).alias("version"), F.lit(since).cast("bigint").alias("since"), *c)
        own(ended, "chunk", "slot", "n", "xx", "xy").sortWithinPartitions("slot", "chunk").write.mode("append").parquet(f"{self.root}/sums")
        own(counts, "chunk", "m", "n").write.mode("append").parquet(f"{self.root}/chunks")
        self.version = version
        return self

    def _ends(self, rows: DataFrame) -> DataFrame:
        """(slot, chunk, n, xx, xy): running sums of each slot, in the order of its chunks, decayed from end to end."""
        forgetting = self.model[1]

        def batches(it: Iterator) -> Iterator:
            import pandas as pd

            own, x, y, at = None, 0.0, 0.0, 0
            for pdf in it:
                out = []
                for slot, chunk, xx, xy, n, seed in pdf.itertuples(index=False):
                    if slot != own:
                        own, x, y, at = slot, 0.0, 0.0, n
                    decay = forgetting ** (n - at)
                    x, y, at = x * decay + xx, y * decay + xy, n
                    if not seed:
                        out.append((slot, chunk, n, x, y))
                yield pd.DataFrame(out, columns=["slot", "chunk", "n", "xx", "xy"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.select("slot", "chunk", "xx", "xy", "n", "seed").repartition(n, "slot").sortWithinPartitions("slot", "chunk")
        return ordered.mapInPandas(batches, "slot int, chunk bigint, n bigint, xx double, xy double")

    def states_as_of(self, lines: Timeline, asked: DataFrame) -> DataFrame:
        """(pos, slot, xx, xy): true sums of every slot before each place ``pos`` of ``asked``."""
        forgetting = self.model[1]
        wanted = written(asked.select(F.col("pos").cast("bigint").alias("pos")).distinct().withColumn("chunk", F.expr(f"pos div {self.chunk}")), "asked")
        counts = self.chunks().select("chunk", "m", "n")
        # updates before a chunk that was asked for: those up to the end of the last chunk that has any before it
        line = wanted.select("chunk").distinct().select("chunk", F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("upto"))
        ended = counts.select("chunk", F.lit(0).alias("asks"), (F.col("n") + F.col("m")).alias("upto"))
        both = line.unionByName(ended)
        n_at = both.where("asks = 1").select("chunk").join(ended.select(F.col("chunk").alias("_c"), "upto"), F.col("_c") < F.col("chunk"), "left").groupBy("chunk").agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n_at"))
        slots = self.rows().select("slot", "chunk", F.struct("n", "xx", "xy").alias("x"), F.lit(0).alias("asks"))
        marks = slots.select("slot").distinct().crossJoin(wanted.select("chunk").distinct()).select("slot", "chunk", F.lit(None).cast("struct<n:bigint,xx:double,xy:double>").alias("x"), F.lit(1).alias("asks"))  # a stated set of lines for each slot
        # a mark comes before its own chunk's row, so it takes what was known when the chunk began
        last = F.last("x", True).over(Window.partitionBy("slot").orderBy("chunk", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        begun = slots.unionByName(marks).withColumn("x", last).where("asks = 1 and x is not null").join(n_at, "chunk")
        decay = F.pow(F.lit(forgetting), F.col("n_at") - F.col("x.n"))
        carry = begun.join(wanted, "chunk").select(F.col("pos").alias("key"), "chunk", F.lit(fold.CARRY).alias("pos"), F.lit("carry").alias("event"), F.lit(0).alias("model"), "slot", (F.col("x.xx") * decay).alias("xx"), (F.col("x.xy") * decay).alias("xy"))
        near = lines.events(False).drop("key").withColumnRenamed("pos", "_at").join(wanted.withColumnRenamed("pos", "key"), "chunk").where(F.col("_at") < F.col("key")).withColumnRenamed("_at", "pos")
        rows = fold.with_defaults(carry).unionByName(fold.with_defaults(near))

        def absorb(models, key, row):
            pos, event, context, offers, chosen, propensity, target, reward, number, slot, xx, xy = row
            if event == "carry":
                models.load(number, slot, xx, xy)
            else:
                models.update(context, offers, reward)
            return ()

        def finish(models, key, chunk):
            m = models.models[0]
            for j in m.xx:
                yield key, chunk, j, m.scale * m.xx[j], m.scale * m.xy[j]

        return fold.by_chunk(rows, [self.model], "chunk bigint, slot int, xx double, xy double", absorb, finish).select(F.col("key").alias("pos"), "slot", "xx", "xy")
