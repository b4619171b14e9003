"""A data source for the lines of log files, plain or gzip by their first bytes, in batches and streams.

``spark.read.format("log_lines").load(path)`` has a row for each line: file, part, place in the part, value. Plain
files are cut into byte ranges; a line belongs to the range in which it begins. A compressed file is one part that
is inflated as it is read, member after member, never held whole. ``numbered`` counts the lines of each part and adds what comes before:
line numbers of files that many tasks read, from 1, counting blank lines.

``spark.readStream.format("log_lines").load(path)`` has the line numbers at once: offsets are (bytes, lines) of each
file. A file that grows is read on from where it ended, up to its last whole line. A file that is compressed is
taken when it appears.

Lines end with \\n, \\r\\n or \\r, in both kinds of files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, SCHEMA = "log_lines", "file string, part int, place bigint, line bigint, value string"
RANGE, CHUNK, SEND = 1 << 24, 1 << 20, 10_000
_ENDS = re.compile(rb"\r\n|\n|\r")


@dataclass
class Part(InputPartition):
    """Bytes begin to end of a file, whose first line has the number ``line`` (None: not known)."""

    file: str
    number: int
    begin: int
    end: int
    packed: bool
    line: int | None = None


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder, in order."""
    from pyarrow import fs

    system, at = _filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class _Files:
    """What readers share: the files of an option ``path``."""

    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def open(self, file: str):
        return _filesystem(self.path)[0].open_input_file(file)

    def packed(self, file: str) -> bool:
        with self.open(file) as f:
            return f.read(2) == b"\x1f\x8b"

    def lines(self, part: Part) -> Iterator[bytes]:
        with self.open(part.file) as f:
            yield from _inflated(f) if part.packed else _within(f, part.begin, part.end)

    def batches(self, part: Part) -> Iterator:
        import pyarrow as pa

        held: list[str] = []
        place = 0

        def batch():
            n = len(held)
            line = pa.nulls(n, pa.int64()) if part.line is None else pa.array(range(part.line + place, part.line + place + n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array([part.number] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), line, pa.array(held, pa.string())], ["file", "part", "place", "line", "value"])

        for value in self.lines(part):
            held.append(value.decode("utf-8", "replace"))
            if len(held) == SEND:
                yield batch()
                place, held = place + SEND, []
        if held:
            yield batch()


def _within(f, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin at bytes begin to end; the last one is read to its end."""
    start = max(begin - 1, 0)
    f.seek(start)
    data, at = f.read(end - start), 0
    while (more := f.read(CHUNK)) and not _ENDS.search(data, max(end - start - 1, 0), len(data) - 1):  # an end in sight, and a byte behind it
        data += more
    data += more
    if begin:
        if (first := _ENDS.search(data)) is None:
            return
        at = first.end()
    while at < end - start and at < len(data):
        found = _ENDS.search(data, at)
        yield data[at : found.start()] if found else data[at:]
        at = found.end() if found else len(data)


def _inflated(f) -> Iterator[bytes]:
    """The lines of a gzip file of any number of members."""
    left, unpack = b"", zlib.decompressobj(31)
    while data := f.read(CHUNK):
        while data:
            left += unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        *whole, left = _cut(left)
        yield from whole
    if left:
        yield from (x for x in _ENDS.split(left.removesuffix(b"\r")))


def _cut(data: bytes) -> list[bytes]:
    """Lines, and what isn't sure to be one yet: a \\r at the end may go on with \\n."""
    if data.endswith(b"\r"):
        *whole, last = _ENDS.split(data[:-1])
        return [*whole, last + b"\r"]
    return _ENDS.split(data)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Part]:
        out = []
        for file, size in files_of(self.path):
            packed = self.packed(file)
            step = max(size, 1) if packed else self.range
            out += [Part(file, i, begin, min(begin + step, size), packed) for i, begin in enumerate(range(0, size, step))]
        return out

    def read(self, partition: Part) -> Iterator:
        yield from self.batches(partition)


class _StreamReader(_Files, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Bytes and lines of each file up to its last whole line. Counts only what is new."""
        for file, size in files_of(self.path):
            begin, lines = self.known.get(file, (0, 0))
            if size > begin:
                if self.packed(file):
                    self.known[file] = [size, 0]
                    continue
                with self.open(file) as f:
                    f.seek(begin)
                    last, counted, at = begin, lines, begin
                    rest = b""
                    while data := f.read(min(CHUNK, size - at)):
                        at += len(data)
                        rest += data
                        *whole, left = _cut(rest)
                        counted, last, rest = counted + len(whole), at - len(left), left
                    self.known[file] = [last, counted]
        return {"files": {file: list(x) for file, x in self.known.items()}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for file, (upto, _) in sorted(end["files"].items()):
            begin, lines = start["files"].get(file, (0, 0))
            if upto > begin:
                out.append(Part(file, 0, begin, upto, self.packed(file), lines + 1))
        return out

    def read(self, partition: Part) -> Iterator:
        yield from self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """Register with ``spark.dataSource.register(LogLines)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def numbered(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, line, value) of a file or of a folder's files; each file's lines are numbered from 1."""
    spark.dataSource.register(LogLines)
    lines = spark.read.format(NAME).option("range", str(size)).load(path)
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "part", before.alias("before"))  # a row for each part
    return lines.drop("line").join(offsets, ["file", "part"]).select("file", (F.col("before") + F.col("place") + 1).alias("line"), "value")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of log files as they come and grow."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format(NAME).load(path).select("file", "line", "value")
