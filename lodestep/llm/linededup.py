"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A store counts, for each line key, the documents that hold it. Its runs are tables of
(hash, documents), bucketed and sorted by hash, all with the same number of buckets. Each new
batch of documents is reduced to such counts, freed of hashes already known to be over the
threshold by a merge anti-join with the hot runs, and added as a run of level 0. When a
level has ``FANOUT`` runs they are merged, bucket by bucket, into one run of the next level;
hashes that reach the threshold by the merge move to a hot run. Joins and merges of
runs are sort-merge joins of equal buckets: two runs meet without a shuffle. Where runs of several levels are read together
(``hot_hashes``), the rows that a first join has made are shuffled, as hashes and counts. So a batch costs
work for itself and its share of merges, not for the whole store.

A store lives in a folder and can be opened again: its runs are files, and a manifest, written
anew after each batch, says which they are.

Runs hold 64-bit hashes only. A hash that is hot is a candidate: the lines with
it are looked up once more in the documents and counted by a second hash too, so
that in effect 128 bits decide (``hot_places``). The lines found hot are dropped by
position: what is joined to the texts is a narrow row for each document that loses lines.

A key is the line with ASCII white space stripped at both ends and A-Z lowered.
Keys under ``min_chars`` code points never count. Every row is a document of its
own, whatever its id. Defined results: a null or empty text is one empty line and
stays; a text all of whose lines go becomes empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, ascii_lower, cols, forget, hash128, new_path, quoted

FANOUT, BATCHES = 2, 4
#: Line hashes a bucket is to hold; no more buckets than shuffle partitions.
BUCKET_ROWS = 500_000
_SPACE = " \t\n\x0b\f\r"


def key_of(line: Column) -> Column:
    """Strips first: what lowering would change is never white space."""
    return ascii_lower(F.trim(line, F.lit(_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column) -> Column:
    """The key of each line. Lowering the whole text first needs one test for it, not one a line."""
    return F.transform(_lines(ascii_lower(text)), lambda x: F.trim(x, F.lit(_SPACE)))


class LineStore:
    """Runs of (h, n), line hash and number of documents, by level, and hot runs; in the folder ``root``."""

    def __init__(self, spark: SparkSession, min_docs: int, root: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or new_path(spark, "lines")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hot: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineStore:
        """The store of a folder, as its last complete manifest says."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-*/_SUCCESS")
        done = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        last = max(x.getPath().getParent().getName() for x in done)
        rows = spark.read.parquet(f"{root}/{last}").collect()  # a row for each run
        store = cls(spark, rows[0]["min_docs"], root, rows[0]["fanout"], rows[0]["buckets"])
        store.version = int(last.split("-")[1])
        for r in sorted(rows, key=lambda r: (r["level"] or 0, r["place"])):
            if r["run"] is None:
                continue
            if r["level"] is None:
                store.hot.append(r["run"])
            else:
                store._level(r["level"]).append(r["run"])
            if not spark.catalog.tableExists(r["run"]):
                spark.sql(f"create table {r['run']} (h bigint, n bigint) using parquet clustered by (h) sorted by (h) into {store.buckets} buckets location '{root}/{r['run']}'")
        return store

    def save(self) -> None:
        """Write which runs the store has. A crash before this leaves the store as it was."""
        self.version += 1
        rows = [(level, i, run) for level, runs in enumerate(self.levels) for i, run in enumerate(runs)] + [(None, i, run) for i, run in enumerate(self.hot)]
        named = [(*r, self.min_docs, self.fanout, self.buckets) for r in rows or [(None, 0, None)]]
        self.spark.createDataFrame(named, "level int, place int, run string, min_docs int, fanout int, buckets int").coalesce(1).write.parquet(f"{self.root}/manifest-{self.version:08d}")

    def _level(self, level: int) -> list[str]:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        return self.levels[level]

    def _write(self, df: DataFrame) -> str:
        run = f"lodestep_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.root}/{run}").saveAsTable(run)
        return run

    def _run(self, run: str) -> DataFrame:
        return self.spark.table(run).hint("merge")

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"drop table if exists {run}")
            forget(self.spark, f"{self.root}/{run}")

    def _merged(self, runs: list[str]) -> DataFrame:
        """Equal hashes of sorted runs added up, bucket by bucket."""
        first, *others = runs
        out = self._run(first)
        for run in others:
            other = self._run(run).withColumnRenamed("n", "m")
            out = out.join(other, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, counts: DataFrame) -> None:
        """Add a batch, given as (h, n) with one row for each hash."""
        counts = counts.repartition(self.buckets, "h")
        for run in self.hot:
            counts = counts.hint("merge").join(self._run(run).select("h"), "h", "left_anti")
        self._put(0, self._write(counts))

    def _put(self, level: int, run: str) -> None:
        self._level(level).append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            self._put_hot(self._write(self._run(merged).where(F.col("n") >= self.min_docs)))
            rest = self._write(self._run(merged).where(F.col("n") < self.min_docs))
            self._drop([*old, merged])
            self._put(level + 1, rest)

    def _put_hot(self, run: str) -> None:
        self.hot.append(run)
        if len(self.hot) > self.fanout:
            old, self.hot = self.hot, []
            self.hot.append(self._write(self._merged(old)))
            self._drop(old)

    def hot_hashes(self) -> DataFrame:
        """(h): all hashes that reach the threshold over all runs. The runs stay as they are."""
        rest = [run for level in self.levels for run in level]
        parts = [self._run(run).select("h") for run in self.hot]
        parts += [self._merged(rest).where(F.col("n") >= self.min_docs).select("h")] if rest else []
        out = self.spark.createDataFrame([], "h bigint")
        for part in parts:
            out = out.unionByName(part)
        return out  # a hash is hot in one run, or not hot yet

    def forget(self) -> None:
        """Delete the runs."""
        self._drop([*self.hot, *(run for level in self.levels for run in level)])
        self.levels, self.hot = [], []


def batch_counts(docs: DataFrame, *, text: str = "text", min_chars: int = 1, by: Column | None = None) -> DataFrame:
    """(batch, h, n) of the documents, each document counting once for a hash; ``by`` numbers batches (one by default)."""
    t = F.col(quoted(text))
    hashes = F.transform(F.filter(_keys(t), lambda k: F.length(k) >= min_chars), lambda k: F.xxhash64(k))
    rows = docs.where(t.isNotNull()).select((F.lit(0) if by is None else by).cast("int").alias("batch"), F.explode(F.array_distinct(hashes)).alias("h"))
    return rows.groupBy("batch", "h").agg(F.count("*").alias("n"))


def hot_places(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, key: Column | None = None) -> DataFrame:
    """(key, places): of each document text that loses lines, their positions from 0. ``key`` names a text, by default its hash with the row."""
    spark = docs.sparkSession
    t = F.col(quoted(text))
    key = row_key(docs, text) if key is None else key
    path = new_path(spark, "incoming")
    batch_counts(docs, text=text, min_chars=min_chars, by=F.pmod(F.xxhash64(key), F.lit(batches))).write.partitionBy("batch").parquet(path)
    incoming = spark.read.schema("batch int, h bigint, n bigint").parquet(path)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = LineStore(spark, min_docs, buckets=max(1, min(most, -(-incoming.count() // BUCKET_ROWS))))
    for batch in range(batches):
        store.add(incoming.where(F.col("batch") == batch).select("h", "n"))
    forget(spark, path)

    lines = F.transform(_keys(t), lambda k: F.struct(F.length(k).alias("c"), F.xxhash64(k).alias("h"), F.xxhash64(F.lit(9), k).alias("h2")))
    places = docs.where(t.isNotNull()).select(key.alias("key"), F.posexplode(lines).alias("at", "x")).where(F.col("x.c") >= min_chars)
    near, hot = new_path(spark, "near"), new_path(spark, "hot")
    store.hot_hashes().write.parquet(hot)
    store.forget()
    places.select("key", "at", F.col("x.h").alias("h"), F.col("x.h2").alias("h2")).join(spark.read.schema("h bigint").parquet(hot), "h", "left_semi").write.parquet(near)
    found = spark.read.schema("key binary, at int, h bigint, h2 bigint").parquet(near)
    # a document's repeats of a line count once; rows that agree in everything have one key but are documents of their own
    same = found.groupBy("h", "h2", "key", "at").agg(F.count("*").alias("rows"))
    held = same.groupBy("h", "h2", "key").agg(F.min_by("rows", "at").alias("rows"))
    sure = held.groupBy("h", "h2").agg(F.sum("rows").alias("n")).where(F.col("n") >= min_docs).select("h", "h2")
    return found.join(sure, ["h", "h2"], "left_semi").groupBy("key").agg(F.collect_set("at").alias("places"))


def row_key(docs: DataFrame, text: str = "text") -> Column:
    """Key of a document: hash of its text and of its other columns, so that copies are spread over tasks."""
    others = [F.col(quoted(c)).cast("string") for c in docs.columns if c != text and docs.schema[c].dataType.typeName() in ("long", "integer", "string")]
    return hash128(F.col(quoted(text)), *others)


def without_common_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the text freed of lines that at least ``min_docs`` documents hold; n_lines (before) and n_dropped under the prefix."""
    key = row_key(docs, text)
    places = hot_places(docs, text=text, min_docs=min_docs, min_chars=min_chars, batches=batches, key=key)
    named = docs.select(*cols(docs), key.alias(P + "key"))
    joined = named.join(places.select(F.col("key").alias(P + "k"), F.col("places").alias(P + "places")), F.col(P + "key") == F.col(P + "k"), "left")
    gone, old = F.col(P + "places"), F.col(quoted(text))
    every = F.transform(_lines(old), lambda x, i: i)
    stay = F.aggregate(F.array(_lines(old)), F.array().cast("array<string>"), lambda a, lines: F.transform(F.array_except(every, gone), lambda i: F.get(lines, i)))  # splits the text once
    new = F.when(gone.isNull(), old).otherwise(F.array_join(stay, "\n"))
    return joined.select(*(new.alias(text) if c == text else F.col(quoted(c)) for c in docs.columns), F.size(_lines(old)).cast("bigint").alias(P + "n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(P + "n_dropped"))
