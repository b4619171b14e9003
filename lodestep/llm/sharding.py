"""Shards along a Hilbert curve. DataFrame functions only.

Several metadata dimensions (language, source, size) are quantised to
``BITS`` bits each; the Hilbert index of the cell puts rows that are near in all
dimensions next to each other, and runs of equal row counts are cut from that
order. Each shard then covers a small box of every dimension, so that the
minimum and maximum of its files prune on any of them.

String dimensions are quantised by the rank of the value among all values,
weighted by rows (equal depth), in value order; sizes by their logarithm. Exact
global ranks come from a range partitioning: the place within a partition plus
the rows of the partitions before it. No step sorts all rows in one task, and a
cell that holds most rows is split by the tie-breakers (text hash, id).

Defined results: a null text has size 1; a null dimension is its lowest cell.
Rows that agree in everything take neighbouring places in either order. Fewer
rows than shards leave some shards empty. Law ``rows``: counts differ by at most one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, quoted, written

BITS = 5


def _xor(a: str, b: str) -> str:
    """Exclusive or in a form that every SQL dialect reads the same."""
    return f"(({a} | {b}) - ({a} & {b}))"


def hilbert_steps(dims: list[str], bits: int) -> list[dict[str, str]]:
    """SQL steps, each a set of assignments to the columns x0.. and h, that end with the Hilbert index in h.

    Gray-code form: from the highest bit down, a dimension's bit either inverts
    the lower bits of the first dimension or swaps them with its own; then the
    transposed bits are gray-decoded and interleaved.
    """
    n = len(dims)
    steps = [{f"x{i}": f"cast({d} as bigint)" for i, d in enumerate(dims)}]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            flip = f"case when (x{i} & {q}) <> 0 then {_xor('x0', str(low))} else "
            if i == 0:
                steps.append({"x0": flip + "x0 end"})
            else:
                t = f"({_xor('x0', f'x{i}')} & {low})"
                steps.append({"x0": flip + f"{_xor('x0', t)} end", f"x{i}": f"case when (x{i} & {q}) <> 0 then x{i} else {_xor(f'x{i}', t)} end"})
    for i in range(1, n):
        steps.append({f"x{i}": _xor(f"x{i}", f"x{i - 1}")})
    t = "0"
    for b in range(bits - 1, 0, -1):
        bit = f"(case when (x{n - 1} & {1 << b}) <> 0 then {(1 << b) - 1} else 0 end)"
        t = bit if t == "0" else _xor(t, bit)
    steps.append({"xt": f"cast({t} as bigint)"})
    steps.append({f"x{i}": _xor(f"x{i}", "xt") for i in range(n)})
    parts = [f"(case when (x{i} & {1 << b}) <> 0 then {1 << (b * n + n - 1 - i)} else 0 end)" for b in range(bits) for i in range(n)]
    steps.append({"h": f"cast({' + '.join(parts)} as bigint)"})
    return steps


def with_hilbert(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with the Hilbert index of the cells in ``dims`` (each under 2 ** bits) as ``out``."""
    keep = df.columns
    for step in hilbert_steps(dims, bits):
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.select(*(F.col(quoted(c)) for c in keep), F.col("h").alias(out))


def with_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with each row's exact place from 0 in the order of the columns ``order``, without sorting in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    own = [c for c in df.columns]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(placed.select(*(F.col(quoted(c)) for c in own), place.alias(P + "at")), "placed")
    part, within = F.shiftright(P + "at", 33), F.col(P + "at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias(P + "part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select(P + "part", (F.sum("n").over(Window.orderBy(P + "part")) - F.col("n")).alias(P + "before"))
    return placed.withColumn(P + "part", part).join(F.broadcast(before), P + "part").select(*(F.col(quoted(c)) for c in own), (within + F.col(P + "before")).alias(out))


def _value_cells(df: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, cell): equal-depth cells of a string column's values, in value order."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(n, column).withColumn("p", F.spark_partition_id()), "values")
    sums = ranged.groupBy("p").agg(F.sum("n").alias("s"))  # a row for each partition
    base = sums.select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("b"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy(F.col(column).asc_nulls_first()))
    first = ranged.withColumn("upto", upto).join(F.broadcast(base), "p")
    return first.select(F.col(column).alias("v"), F.floor((F.col("upto") - F.col("n") + F.col("b")) * (1 << bits) / F.col("total")).cast("int").alias("cell"))


#: Sizes at which cells begin: the powers of the square root of 2 from 16 bytes up.
SIZE_STEPS = [math.ceil(2 ** (4 + (c + 1) / 2)) for c in range((1 << BITS) - 1)]


def _size_cell(size: Column) -> Column:
    """Cell of a size: how many steps it reaches."""
    return F.size(F.filter(F.array(*(F.lit(x).cast("bigint") for x in SIZE_STEPS)), lambda x: x <= size)).cast("int")


def hilbert_shards(docs: DataFrame, n_shards: int, *, id: str = "doc_id", text: str = "text", values: tuple[str, ...] = ("lang", "source"), whole: bool = False) -> DataFrame:
    """One narrow row per row of ``docs``: id, size, text_crc32, hilbert, shard, slot. With ``whole``, all columns of ``docs`` too, as ``doc``.

    The dimensions are the string columns ``values`` and the size.
    """
    t = F.col(quoted(text))
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint")
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary")).cast("bigint")
    narrow = docs.select(F.col(quoted(id)).alias("id"), size.alias("size"), crc.alias("crc"), *(F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(values)), *([F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc")] if whole else []))
    rows = written(narrow, "metadata")
    celled = rows.withColumn(f"c{len(values)}", _size_cell(F.col("size")))
    for i in range(len(values)):
        cells = _value_cells(rows, f"v{i}", BITS).withColumnsRenamed({"v": f"w{i}", "cell": f"c{i}"})
        celled = celled.join(cells, F.col(f"v{i}").eqNullSafe(F.col(f"w{i}"))).drop(f"w{i}")
    indexed = with_hilbert(celled, [f"c{i}" for i in range(len(values) + 1)], BITS, "hilbert")
    more = ["doc"] if whole else []
    ranked = with_rank(indexed.select("id", "size", "crc", "hilbert", *more), ["hilbert", "crc", "size", "id"], "rank")
    total = max(1, rows.count())
    shard = F.expr(f"(rank * {n_shards}) div {total}").cast("int")
    begin = F.expr(f"(shard * cast({total} as bigint) + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - begin).select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "hilbert", "shard", "slot", *more)


def write_shards(docs: DataFrame, path: str, n_shards: int, *, id: str = "doc_id", text: str = "text", values: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Write the rows of ``docs`` by shard, in curve order, under ``path``/data, and a manifest under ``path``/manifest, which is returned.

    The manifest has, for each shard, the number of rows and bytes and the least and
    greatest size and value of each dimension: a filter on any of them names the shards to read
    (``pruned``). Nulls lie outside of least and greatest; ``nulls_`` counts them.
    """
    spark = docs.sparkSession
    placed = hilbert_shards(docs, n_shards, id=id, text=text, values=values, whole=True)
    rows = placed.select("shard", "slot", "size", "doc.*")
    ordered = rows.repartitionByRange(max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.withColumnRenamed("shard", P + "shard").drop("slot", "size").write.partitionBy(P + "shard").parquet(f"{path}/data")
    bounds = []
    for c in ("size", *values):
        bounds += [F.min(quoted(c)).alias(f"least_{c}"), F.max(quoted(c)).alias(f"most_{c}"), F.sum(F.col(quoted(c)).isNull().cast("bigint")).alias(f"nulls_{c}")]
    manifest = rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def pruned(manifest: DataFrame, column: str, least, most) -> list[int]:
    """The shards that may hold rows with ``column`` from ``least`` to ``most``."""
    overlap = (F.col(quoted(f"least_{column}")) <= F.lit(most)) & (F.col(quoted(f"most_{column}")) >= F.lit(least))
    return sorted(r["shard"] for r in manifest.where(overlap).select("shard").collect())  # a row for each shard
