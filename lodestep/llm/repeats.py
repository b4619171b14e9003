"""Removal of repeated byte strings: a sparse suffix order by distributed prefix doubling.

Every byte goes that is covered by a string of ``threshold`` bytes which also starts anywhere else.

**Sample.** Comparing every suffix would sort each byte of a corpus many times over. Places are sampled by content
instead: of each ``w`` neighbouring k-byte strings the one with the smallest hash (leftmost among equals). What a string
of ``threshold`` bytes holds decides which sampled places lie between the first and the last that its own windows
choose, so equal strings hold the same ones: a repeated string shows in repeated sampled places.

**Prefix doubling.** A place's rank is at first that of its bytes up to the next sampled place. Then Spark sorts the
pairs (rank, rank of the place 1, 2, 4, ... places on) with their positions and ranks them anew, by the first row with an equal
pair. Places with a rank of their own are unique and go; so do those whose prefix is past the threshold. Rows are sorted
by pair *and position* over ranges, so a pair that is everywhere is cut over partitions; a row for each partition
says where an equal pair goes on.

**Exact check.** Neighbouring starts with the same first and last sampled place form a run. The ranks of two
overlapping powers of two tell whether what lies between these places occurs again. If it doesn't, no start of the run is
repeated. If it does, the bytes are compared by 128-bit hashes: all bytes of the run first (if they occur again, every start is
repeated), and where runs with an equal inner part differ, blocks of ``BLOCK`` starts at equal distance from the
first sampled place, and of these what is still open start by start. ``settled`` is one step for all three.

Equal texts are collapsed before all this: all their bytes are repeated, if there are enough of them, and one copy stands for them.

Defined results: null and empty texts, and texts under the threshold, lose nothing.
Rows are texts of their own whatever their ids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .common import P, cols, forget, new_path, quoted

#: Window bytes that are hashed at a time, starts in a block of the exact check, rows sent to Spark at a time.
PIECE, BLOCK, SEND = 1 << 20, 16, 50_000
KEY = ["h", "h2"]
#: Spark's own setting: the shuffle files of a step go as soon as its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MIX = 0x9E3779B97F4A7C15


class Tables:
    """Tables of intermediate rows, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.write(df.write, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, writer, path: str, name: str | None = None) -> None:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.option("path", path).saveAsTable(name) if name else writer.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)

    def drop(self) -> None:
        for path in self.paths:
            forget(self.spark, path)
        self.paths = []


def window(threshold: int) -> tuple[int, int]:
    """(k, w): length of the hashed strings and how many of them compete. Two windows fit into the threshold."""
    if threshold < 8:
        raise ValueError("threshold must be at least 8 bytes")
    k = 1
    while 2 * k <= min(16, threshold // 4):
        k *= 2
    return k, max(1, (threshold - k + 1) * 5 // 12)


def _hashes(data, k: int):
    """32-bit hash, in the upper half, of the k bytes from each place; k is a power of two."""
    import numpy as np

    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    step = 1
    while step < k:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x94D049BB133111EB)) & np.uint64(0xFFFFFFFF00000000)


def _minima(v, w: int):
    """The least of each w neighbours."""
    import numpy as np

    m, size = v, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(v) - w + 1], m[w - size : w - size + len(v) - w + 1])


def sampled(data, starts, k: int, w: int):
    """(text, s, a) of texts laid end to end, from ``starts`` (with the end last): from window s on, up to the next row's, place a of the text is chosen."""
    import numpy as np

    windows = np.diff(starts) - k - w + 2
    found_p, found_x, last = [], [], -1
    every = len(data) - k - w + 2
    for lo in range(0, max(every, 0), PIECE):
        hi = min(lo + PIECE, every)
        h = _hashes(data[lo : hi + w + k - 2], k)
        x = (_minima(h | np.arange(len(h), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
        new = np.empty(len(x), dtype=bool)
        new[0], new[1:] = x[0] != last, x[1:] != x[:-1]
        inside = starts[(starts >= lo) & (starts < hi)] - lo
        new[inside] = True
        at = np.flatnonzero(new)
        found_p.append(at + lo)
        found_x.append(x[at])
        last = x[-1]
    if not found_p:
        return (np.empty(0, dtype=np.int64),) * 3
    p, x = np.concatenate(found_p), np.concatenate(found_x)
    text = np.searchsorted(starts, p, side="right") - 1
    good = p - starts[text] < windows[text]
    text, p, x = text[good], p[good], x[good]
    return text, p - starts[text], x - starts[text]


def _laid(column):
    """The bytes of a string column end to end, and where each row begins, with the end last."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _sent(target, columns: dict) -> Iterator:
    """Arrow batches of the columns, a bounded number of rows each."""
    import pyarrow as pa

    arrays = [pa.array(columns[f.name], f.type) for f in target]
    for at in range(0, len(arrays[0]), SEND):
        yield pa.RecordBatch.from_arrays([a.slice(at, SEND) for a in arrays], schema=target)


def _mapped(df: DataFrame, step, schema: str) -> DataFrame:
    """``step(columns by name)`` of each batch gives the columns of ``schema`` as arrays."""
    names, kind = df.columns, _parse_datatype_string(schema)

    def batches(it: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for batch in it:
            if batch.num_rows:
                yield from _sent(target, step(dict(zip(names, batch.columns))))

    return df.mapInArrow(batches, kind)


def phrases(texts: DataFrame, threshold: int) -> DataFrame:
    """(h, h2, i, begin, end, r): of each sampled place but a text's last, its bytes up to the next one's k bytes, and their hash."""
    k, w = window(threshold)

    def step(batch: dict) -> dict:
        import numpy as np
        import xxhash

        data, starts = _laid(batch["text"])
        text, _, a = sampled(data, starts, k, w)
        same = np.flatnonzero(text[1:] == text[:-1])
        first = np.searchsorted(text, text[same])
        begin, end, of = a[same], a[same + 1] + k, text[same]
        view = memoryview(data)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[b:e]) for b, e in zip((begin + starts[of]).tolist(), (end + starts[of]).tolist())), dtype=np.uint64, count=len(same)).view(np.int64)
        return {"h": batch["h"].to_numpy()[of], "h2": batch["h2"].to_numpy()[of], "i": (same - first).astype(np.int32), "begin": begin, "end": end, "r": hashes}

    return _mapped(texts.select(*KEY, "text"), step, "h bigint, h2 bigint, i int, begin bigint, end bigint, r bigint")


#: How a row stands in its partition: in a first group of several rows, a first row alone in its group, a last row alone, and the marks of a partition's first and last pair.
_FIRST, _FIRST_ALONE, _LAST_ALONE, _MARK_FIRST, _MARK_LAST = 1, 2, 3, 4, 5


def reranked(pairs: DataFrame, tables: Tables) -> DataFrame:
    """(h, h2, i, begin, end, rank) of the rows whose pair (r, r2) isn't unique. The rank is that of the first row with the pair."""
    order = ["r", "r2", *KEY, "i"]
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.select("r", "r2", *KEY, "i", "begin", "end").repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = _parse_datatype_string("part int, stands int, h bigint, h2 bigint, i int, begin bigint, end bigint, rank bigint, r bigint, r2 bigint")

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        names = ["r", "r2", "h", "h2", "i", "begin", "end"]
        held, done, group, before = None, 0, 0, None  # the row that waits for the next one; its number; where its group began; the pair before it
        first = None

        def told(rows: dict, n: int, end: bool):
            """The first n rows; all but the last one if more follow."""
            nonlocal held, done, group, before
            r, r2 = rows["r"], rows["r2"]
            new = np.empty(n, dtype=bool)
            new[0] = before is None or before != (r[0], r2[0])
            new[1:] = (r[1:] != r[:-1]) | (r2[1:] != r2[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(n) + done, group))
            m = n if end else n - 1
            alone = new[:m] & np.append(new[1:], True)[:m]
            stands = np.where(at[:m] == 0, np.where(alone, _FIRST_ALONE, _FIRST), 0)
            if end and alone[-1] and at[-1]:
                stands[-1] = _LAST_ALONE
            keep = np.flatnonzero(~alone | (stands > 0))
            out = {c: rows[c][keep] for c in ("h", "h2", "i", "begin", "end")}
            out |= {"part": np.full(len(keep), part), "stands": stands[keep], "rank": at[keep] + (part << 40), "r": pa.nulls(len(keep), pa.int64()), "r2": pa.nulls(len(keep), pa.int64())}
            if m:
                before, group = (int(r[m - 1]), int(r2[m - 1])), int(at[m - 1])
            held, done = (None if end else {c: rows[c][-1:] for c in names}), done + m
            yield from _sent(target, out)
            if end:
                marks = {c: [0, 0] for c in ("h", "h2", "i", "begin", "end")}
                yield from _sent(target, marks | {"part": [part] * 2, "stands": [_MARK_FIRST, _MARK_LAST], "rank": [part << 40, int(at[-1]) + (part << 40)], "r": [first[0], int(r[-1])], "r2": [first[1], int(r2[-1])]})

        for batch in it:
            if batch.num_rows:
                rows = {c: x.to_numpy() for c, x in zip(names, batch.columns)}
                first = first or (int(rows["r"][0]), int(rows["r2"][0]))
                if held is not None:
                    rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
                yield from told(rows, len(rows["r"]), False)
        if held is not None:
            yield from told(held, 1, True)

    table = tables.keep(ordered.mapInArrow(batches, schema), "ranks")
    marks = {}
    for x in table.where(F.col("stands") >= _MARK_FIRST).collect():  # two rows a partition
        marks.setdefault(x["part"], {})[x["stands"]] = ((x["r"], x["r2"]), x["rank"])
    fixes, last = [], None
    parts = sorted(marks)
    for part, after in zip(parts, [*parts[1:], None]):
        (first, rank), (end, end_rank) = marks[part][_MARK_FIRST], marks[part][_MARK_LAST]
        goes_on = after is not None and marks[after][_MARK_FIRST][0] == end
        follows = last is not None and last[0] == first
        rank = last[1] if follows else rank
        fixes.append((part, rank, follows or (first == end and goes_on), goes_on))
        last = end, rank if first == end else end_rank
    fix = table.sparkSession.createDataFrame(fixes or [(-1, 0, False, False)], "part int, of_first bigint, first_again boolean, last_again boolean")
    stands = F.col("stands")
    gone = ((stands == _FIRST_ALONE) & ~F.col("first_again")) | ((stands == _LAST_ALONE) & ~F.col("last_again"))
    rank = F.when(stands.isin(_FIRST, _FIRST_ALONE), F.col("of_first")).otherwise(F.col("rank"))
    joined = table.where(stands < _MARK_FIRST).join(F.broadcast(fix), "part")  # a row for each partition
    return joined.where(~gone).select(*KEY, "i", "begin", "end", rank.alias("rank"))


def doubled(ranks: DataFrame, distance: int, threshold: int) -> DataFrame:
    """Pairs (r, r2) of the ranks of places ``distance`` apart, as far as they are within the threshold."""
    from pyspark.sql import Window

    on = Window.partitionBy(*KEY).orderBy("i").rangeBetween(distance, distance)
    ahead = ranks.select(*KEY, "i", "begin", F.col("rank").alias("r"), F.max("rank").over(on).alias("r2"), F.max("end").over(on).alias("end"))
    return ahead.where(F.col("r2").isNotNull() & (F.col("end") - F.col("begin") <= threshold))


def levels(texts: DataFrame, threshold: int, tables: Tables) -> list[DataFrame]:
    """Ranks of prefixes of 1, 2, 4, ... sampled places, until every one is unique or past the threshold."""
    own = Tables(tables.spark)
    first = own.keep(phrases(texts, threshold).withColumn("r2", F.lit(0).cast("bigint")), "phrases")
    out, distance = [reranked(first, tables)], 1
    own.drop()
    while not out[-1].isEmpty():
        out.append(reranked(doubled(out[-1], distance, threshold), tables))
        distance *= 2
    return out[:-1]


#: Starts lo to hi of a text: their class c, the hash of all their bytes, their first sampled place, and whether their answer is needed.
_OPEN = "c bigint, u bigint, u2 bigint, h bigint, h2 bigint, lo bigint, hi bigint, place bigint, need boolean"


def _mixed(*parts):
    """A 64-bit hash of rows of integers. A class that two contents share only lets more through to the exact check."""
    import numpy as np

    h = np.uint64(0)
    for x in parts:
        h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(_MIX)
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def runs(texts: DataFrame, ranks: list[DataFrame], threshold: int) -> DataFrame:
    """The runs of starts whose inner part occurs again. Their class is the ranks that cover it."""
    k, w = window(threshold)
    further = threshold - k + 1 - w
    every = None
    for level, df in enumerate(ranks):
        one = df.select(*KEY, F.struct(F.lit(level).alias("level"), F.col("i").alias("i"), F.col("rank").alias("rank")).alias("x"))
        every = one if every is None else every.unionByName(one)
    of_text = every.groupBy(*KEY).agg(F.collect_list("x").alias("x"))

    def step(batch: dict) -> dict:
        import numpy as np
        import xxhash

        data, starts = _laid(batch["text"])
        text, s, a = sampled(data, starts, k, w)
        bounds = np.searchsorted(text, np.arange(len(starts)))
        held, ends = batch["x"].values, batch["x"].offsets.to_numpy()
        at_level, at_i, at_rank = (held.field(f).to_numpy() for f in ("level", "i", "rank"))
        found: dict[str, list] = {c: [] for c in ("c", "u", "u2", "t", "lo", "hi", "place")}
        view = memoryview(data)
        for t in range(len(starts) - 1):
            own_s, own_a = s[bounds[t] : bounds[t + 1]], a[bounds[t] : bounds[t + 1]]
            last = int(starts[t + 1] - starts[t]) - threshold
            cuts = np.unique(np.concatenate([own_s, own_s - further]))
            lo = cuts[(cuts >= 0) & (cuts <= last)]
            hi = np.append(lo[1:] - 1, last)
            one, two = np.searchsorted(own_s, lo, side="right") - 1, np.searchsorted(own_s, lo + further, side="right") - 1
            n = two - one
            level = np.frexp(n.astype(float))[1] - 1
            part = slice(ends[t], ends[t + 1])
            table = np.full((int(level.max()) + 1, len(own_s)), -1, dtype=np.int64)
            there = at_level[part] < len(table)
            table[at_level[part][there], at_i[part][there]] = at_rank[part][there]
            c, c2 = table[level, one], table[level, two - (1 << level)]
            good = np.flatnonzero((c >= 0) & (c2 >= 0))
            lo, hi = lo[good], hi[good]
            for b, e in zip((lo + starts[t]).tolist(), (hi + starts[t] + threshold).tolist()):
                u = xxhash.xxh3_128_intdigest(view[b:e])
                found["u"].append(_signed(u >> 64))
                found["u2"].append(_signed(u))
            for name, values in (("c", _mixed(n[good], c[good], c2[good])), ("t", np.full(len(good), t)), ("lo", lo), ("hi", hi), ("place", own_a[one[good]])):
                found[name].append(values)
        joined = {name: np.concatenate([np.empty(0, dtype=np.int64), *found[name]]) for name in ("c", "t", "lo", "hi", "place")}
        of = joined.pop("t")
        return joined | {"u": found["u"], "u2": found["u2"], "h": batch["h"].to_numpy()[of], "h2": batch["h2"].to_numpy()[of], "need": [True] * len(of)}

    return _mapped(texts.select(*KEY, "text").join(of_text, KEY), step, _OPEN)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def blocks(texts: DataFrame, pending: DataFrame, size: int, threshold: int) -> DataFrame:
    """The same rows for blocks of ``size`` starts at equal distances from the place; a block's class is the bytes that all its starts share."""
    per = pending.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "place", "need")).alias("x"))

    def step(batch: dict) -> dict:
        import xxhash

        found: dict[str, list] = {c: [] for c in ("c", "u", "u2", "h", "h2", "lo", "hi", "place", "need")}
        data, starts = _laid(batch["text"])
        view = memoryview(data)
        held, ends = batch["x"].values, batch["x"].offsets.to_numpy()
        rows = list(zip(*(held.field(f).to_pylist() for f in ("lo", "hi", "place", "need"))))
        for t, (h, h2) in enumerate(zip(batch["h"].to_pylist(), batch["h2"].to_pylist())):
            own = view[int(starts[t]) : int(starts[t + 1])]
            for lo, hi, place, need in rows[ends[t] : ends[t + 1]]:
                for b in range((place - hi) // size, (place - lo) // size + 1):
                    near, far = b * size, b * size + size - 1  # distances from the place
                    first, last = max(lo, place - far), min(hi, place - near)
                    u = xxhash.xxh3_128_intdigest(own[first : last + threshold])
                    c = u if size == 1 else xxhash.xxh3_64_intdigest(own[place - near : place - far + threshold], b)
                    for name, value in zip(found, (_signed(c), _signed(u >> 64), _signed(u), h, h2, first, last, place, need)):
                        found[name].append(value)
        return found

    return _mapped(texts.select(*KEY, "text").join(per, KEY), step, _OPEN)


def settled(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(repeated, pending): rows whose bytes occur again, and those whose class does, with one row for each other content of the class.

    Equal bytes have an equal class, so bytes are counted by their hash alone.
    """
    own = Tables(tables.spark)
    rows = own.keep(rows, "starts")
    kinds = own.keep(rows.groupBy("u", "u2").agg(F.count("*").alias("times"), F.max("need").alias("need"), F.min("c").alias("c"), F.min(F.struct(*KEY, "lo", "hi", "place")).alias("x")), "kinds")
    classes = own.keep(kinds.groupBy("c").agg(F.count("*").alias("kinds"), F.max((F.col("times") == 1) & F.col("need")).alias("wanted")).where("kinds > 1 and wanted").select("c"), "classes")
    again = own.keep(kinds.where("times > 1").select("u", "u2"), "again")
    repeated = tables.keep(rows.select("u", "u2", *KEY, "lo", "hi").join(again, ["u", "u2"], "left_semi").select(*KEY, "lo", "hi"), "repeated")
    pending = tables.keep(kinds.join(classes, "c", "left_semi").select("x.*", (F.col("need") & (F.col("times") == 1)).alias("need")), "pending")
    own.drop()
    return repeated, pending


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(17), text).alias("h"), F.xxhash64(F.lit(71), text).alias("h2")


def _bucketed(df: DataFrame) -> tuple[str, str]:
    """Name and path of a table in buckets of KEY: joins with it don't move its texts."""
    spark = df.sparkSession
    name, path = f"lodestep_texts_{uuid.uuid4().hex}", new_path(spark, "texts")
    Tables(spark).write(df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).sortBy(*KEY).format("parquet"), path, name)
    return name, path


def spans(texts: DataFrame, threshold: int, tables: Tables) -> DataFrame:
    """(h, h2, lo, hi): the starts, from lo to hi, of strings that occur again, of texts that differ from each other."""
    of_ranks = Tables(tables.spark)
    ranks = levels(texts, threshold, of_ranks)
    if not ranks:
        return texts.sparkSession.createDataFrame([], "h bigint, h2 bigint, lo bigint, hi bigint")
    found, pending = settled(runs(texts, ranks, threshold), tables)
    of_ranks.drop()
    for size in (BLOCK, 1):
        more, pending = settled(blocks(texts, pending, size, threshold), tables)
        found = found.unionByName(more)
    return found


def cut(found: DataFrame, threshold: int) -> DataFrame:
    """(h, h2, ranges): of each text with repeated strings, the bytes that go, as joined ranges."""
    at = F.array_sort(F.collect_set(F.struct("lo", (F.col("hi") + threshold).alias("hi"))))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(ranges: Column, x: Column) -> Column:
        last = F.element_at(ranges, -1)
        longer = F.concat(F.slice(ranges, 1, F.size(ranges) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(ranges) == 0), F.array(x)).when(last["hi"] < x["lo"], F.concat(ranges, F.array(x))).otherwise(longer)

    return found.groupBy(*KEY).agg(F.aggregate(at, none, add).alias("ranges"))


def without_repeats(docs: DataFrame, *, text: str = "text", threshold: int = 400) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256 of its texts, under the prefix. ``kept_bytes`` gives the bytes themselves."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    spark = docs.sparkSession
    long = docs.select(t.alias("text")).where(F.octet_length("text") >= threshold)
    once = long.select(*text_key(F.col("text")), "text").groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, path = _bucketed(once)
    texts = spark.table(name)
    tables, out = Tables(spark), Tables(spark)
    ranges = cut(spans(texts, threshold, tables), threshold)
    size = F.octet_length("text").cast("bigint")
    alone = kept(texts.where("copies = 1").join(ranges, KEY))
    whole = texts.where("copies > 1").select(*KEY, size.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    results = out.keep(alone.unionByName(whole), "results")
    tables.drop()
    spark.sql(f"drop table {name}")
    forget(spark, path)
    named = docs.select(*cols(docs), *(c.alias(P + n) for c, n in zip(text_key(t), KEY)), F.octet_length(t).cast("bigint").alias(P + "n_bytes"), F.sha2(t.cast("binary"), 256).alias(P + "sha"))
    renamed = results.select(*(F.col(c).alias(P + "r_" + c) for c in results.columns))
    joined = named.join(renamed, (F.col(P + "h") == F.col(P + "r_h")) & (F.col(P + "h2") == F.col(P + "r_h2")), "left")
    none = F.lit(0).cast("bigint")
    return joined.select(*cols(docs), P + "n_bytes", F.coalesce(P + "r_n_removed", none).alias(P + "n_removed"), F.coalesce(P + "r_n_spans", none).alias(P + "n_spans"), F.coalesce(P + "r_kept_sha256", P + "sha").alias(P + "kept_sha256"))


def kept_bytes(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """What is left of ``data`` without the ranges."""
    ends = [0, *(hi for _, hi in ranges)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(lo for lo, _ in ranges), len(data)]))


def kept(texts: DataFrame) -> DataFrame:
    """(h, h2, n_removed, n_spans, kept_sha256) of texts with their ranges."""

    def step(batch: dict) -> dict:
        import pyarrow as pa

        ranges = [[(x["lo"], x["hi"]) for x in own] for own in batch["ranges"].to_pylist()]
        left = [hashlib.sha256(kept_bytes(t, own)).hexdigest() for t, own in zip(batch["text"].cast(pa.binary()).to_pylist(), ranges)]
        return {"h": batch["h"], "h2": batch["h2"], "n_removed": [sum(hi - lo for lo, hi in own) for own in ranges], "n_spans": [len(own) for own in ranges], "kept_sha256": left}

    return _mapped(texts.select(*KEY, "text", "ranges"), step, "h bigint, h2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
