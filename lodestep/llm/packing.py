"""Token rows of one length, packed by best-fit decreasing, as binary matrices.

Documents are encoded and cut into chunks of at most ``length`` ids without loss.
Each task packs its documents in groups of about ``GROUP_IDS`` ids, so memory is
bounded whatever the partition holds: chunks by falling size, each into the row
with the least room that still takes it. Room is looked up in a segment tree over
capacities (``Capacities``), O(log length) a chunk. Larger groups pack no tighter
once a group has some thousand chunks.

A packed row holds

* ``ids``: ``length`` ids as little-endian uint16 or uint32, padded with ``pad``;
* ``cu_seqlens``: cumulative segment lengths, from 0 to the ids in use;
* ``position_ids``: the place of each id in its segment, same width as ids; it is
  0 again where a segment begins, and 0 in the padding;
* ``doc_ids`` and ``doc_offsets``: for each segment its document and where in the
  document's ids it begins, so that documents can be put together again exactly.

Defined results: null and empty texts give no segment. Equal ids of different
rows stay apart as segments; null ids are carried. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CHUNK, SPACE, broadcast_vocabulary
from .common import quoted

GROUP_IDS = 4_000_000
#: How many chunks' ids a worker remembers (then it starts anew), and of how many characters at most. Only saves time.
MEMO, MEMO_CHARS = 800_000, 64
_OTHER_SPACE = re.compile("[" + SPACE.replace(" ", "").replace("\t-\r", "\t\x0b-\r") + "]")


class Tokens:
    """Ids of whole texts as little-endian bytes: an installed tokenizer, behind a memo of the chunks between spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, width: str):
        import numpy as np
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.dtype(width)
        #: By what follows a space, and by chunks as they stand.
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _ids(self, memo: dict[str, bytes], chunks: list[str], before: str) -> bytes:
        import numpy as np

        if len(memo) > MEMO:
            memo.clear()
        long = {}
        for c in set(chunks):
            if c not in memo:
                (memo if len(c) <= MEMO_CHARS else long)[c] = np.array(self.encode(c if c[:1] == "\n" else before + c), self.width).tobytes()
        return b"".join([memo[c] if c in memo else long[c] for c in chunks] if long else map(memo.__getitem__, chunks))

    def ids(self, text: str | None) -> bytes:
        """White space before a word is at most one space or line break in most texts; then cutting at these is enough."""
        if not text:
            return b""
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or _OTHER_SPACE.search(text):
            return self._ids(self.plain, CHUNK.findall(text), "")
        first = parts.pop(0)
        return self._ids(self.plain, [first], "") + self._ids(self.spaced, parts, " ")


_tokens: dict[tuple, Tokens] = {}


def worker_tokens(token_file: tuple[str, bytes], pattern: str) -> Tokens:
    """This worker's tokenizer for a broadcast vocabulary file."""
    key = (token_file[0], pattern)
    if key not in _tokens:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in token_file[1].splitlines() if x.strip())}
        _tokens[key] = Tokens(ranks, pattern, "<u2" if max(ranks.values()) < 1 << 16 else "<u4")
    return _tokens[key]


class Capacities:
    """Open rows by the room they have: a segment tree over 0..length that finds the least room of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``need``, removed from the tree."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first subtree on the right with a row
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of chunk numbers; each chunk of 1..length, each row of at most length in all."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[i])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.put(room - sizes[i], row)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, *, length: int = 2048, pad: int = 0, id: str = "doc_id", text: str = "text", group_ids: int = GROUP_IDS) -> DataFrame:
    """Packed rows of all documents: n_ids, cu_seqlens, doc_ids, doc_offsets, ids, position_ids."""
    if not 0 < length <= 1 << 16:
        raise ValueError("length must be 1 to 65536")
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([
        T.StructField("n_ids", T.IntegerType()), T.StructField("cu_seqlens", ints), T.StructField("doc_ids", T.ArrayType(docs.schema[id].dataType)),
        T.StructField("doc_offsets", ints), T.StructField("ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()),
    ])

    def packed(chunks: list, width) -> Iterator[tuple]:
        import numpy as np

        for row in best_fit_decreasing([len(c[2]) for c in chunks], length):
            ids, places = np.full(length, pad, width), np.zeros(length, width)
            cuts = [0]
            for i in row:
                begin, end = cuts[-1], cuts[-1] + len(chunks[i][2])
                ids[begin:end] = chunks[i][2]
                places[begin:end] = np.arange(end - begin)
                cuts.append(end)
            yield cuts[-1], cuts, [chunks[i][0] for i in row], [chunks[i][1] for i in row], ids.tobytes(), places.tobytes()

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        coder = worker_tokens(shared.value, pattern)
        width = coder.width
        chunks: list = []
        held = 0

        def full() -> Iterator:
            rows: list = []
            for row in packed(chunks, width):
                rows.append(row)
                if len(rows) == 512:
                    yield rows
                    rows = []
            if rows:
                yield rows

        def sent(rows: list):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), out)], schema=out)

        for batch in it:
            for own, value in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(coder.ids(value.as_py()), width)
                key = own.as_py()
                chunks += [(key, i, ids[i : i + length]) for i in range(0, len(ids), length)]
                held += len(ids)
                if held >= group_ids:
                    yield from map(sent, full())
                    chunks, held = [], 0
        yield from map(sent, full())

    return docs.select(F.col(quoted(id)), F.col(quoted(text))).mapInArrow(batches, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files; the ids of a file, joined, are its matrix in row order."""
    packed.write.parquet(path)


def unpacked(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, doc_offset, ids) of each segment: what packing took in, for checks."""
    schema = T.StructType([T.StructField("doc_id", packed.schema["doc_ids"].dataType.elementType), T.StructField("doc_offset", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4" if wide else "<u2")
                for i, (own, at) in enumerate(zip(r["doc_ids"], r["doc_offsets"])):
                    rows.append((own, at, ids[r["cu_seqlens"][i] : r["cu_seqlens"][i + 1]].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return packed.mapInArrow(batches, schema)
