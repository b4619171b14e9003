"""The log data source: ranges, members, numbers, growing files."""

import gzip
import re

import pytest

from lodestep.sources import lines, logfile

TEXT = "\n".join(f"line {i} " + "é" * (i % 7) for i in range(300)) + "\r\n\r\n\rlast\r\nshort\r" + "x" * 5000 + "\n" + "end without newline"


def want(text):
    out = re.split(r"\r\n|\n|\r", text)
    return out[:-1] if out[-1] == "" else out


@pytest.mark.parametrize("size", [1, 2, 3, 17, 100, 1 << 20])
def test_ranges_of_any_size(size, tmp_path):
    data = TEXT.encode()[-7000:] if size < 10 else TEXT.encode()
    (tmp_path / "a").write_bytes(data)
    reader = lines._Reader({"path": str(tmp_path / "a"), "range": str(size)})
    parts = reader.partitions()
    assert [x.decode("utf-8", "replace") for p in parts for x in reader.lines(p)] == want(data.decode("utf-8", "replace"))


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_members(chunk, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    data = TEXT.encode()
    cuts = [0, 1, 50, 51, 4000, len(data)]
    (tmp_path / "a").write_bytes(b"".join(gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:])))
    reader = lines._Reader({"path": str(tmp_path / "a")})
    (part,) = reader.partitions()
    assert part.packed and [x.decode() for x in reader.lines(part)] == want(TEXT)


def test_plain_and_packed_files_have_the_same_numbers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "plain").write_bytes(TEXT.encode())
    (folder / "packed").write_bytes(gzip.compress(TEXT.encode()))
    (folder / "empty").write_bytes(b"")
    rows = lines.numbered(spark, str(folder), 999).collect()
    for name in ("plain", "packed"):
        own = sorted((r.line, r.value) for r in rows if r.file.endswith(name))
        assert own == list(enumerate(want(TEXT), 1))
    assert sorted(tuple(r) for r in logfile.read_log(spark, str(folder / "packed")).collect()) == list(enumerate(want(TEXT), 1))
    with pytest.raises(Exception, match="nowhere"):
        lines.numbered(spark, str(tmp_path / "nowhere")).count()


def test_a_stream_numbers_lines_of_growing_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        query = lines.stream(spark, str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in spark.read.parquet(str(out)).collect())

    (folder / "a").write_bytes(b"one\n\nthree\nhal")
    assert run() == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "three")]
    with (folder / "a").open("ab") as f:
        f.write(b"f\r\nfive\n")
    (folder / "b").write_bytes(gzip.compress(b"x\ny"))
    assert run() == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "three"), ("a", 4, "half"), ("a", 5, "five"), ("b", 1, "x"), ("b", 2, "y")]
    assert len(run()) == 7
