"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding. It is
the token that ends there and whose pairing with the last token of the prefix
before it is itself a stable encoding. Storing that one token per prefix gives
the encoding by walking back from the end, lets bytes be appended without
touching what is stored, and limits the work after an edit to its neighbourhood.

* ``Vocabulary``: ranks, the automaton that lists the tokens ending at a byte,
  and the memoised test whether two tokens may stand side by side.
* ``PrefixTable``: one piece with its prefix table; ``append`` and ``replace``.
* ``Encoder``: whole texts, piece by piece of the split pattern, with a bounded
  memo of chunks; ``encode``, ``decode``, ``digest``.
* ``encode_documents``: the operator over a DataFrame.

Nulls and empty texts encode to no ids. Bytes that no rank covers raise an
error: byte-level ranks contain all 256 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import by_place, refuse_taken

#: Characters with the Unicode property White_Space, as the split pattern's \s means them.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space and what follows up to the next: the split pattern never joins characters of two such chunks.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Entries a worker's memos hold before they start anew; they only save time.
MEMO_CHUNKS, MEMO_PAIRS = 400_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Ranks with what the prefix tables ask of them."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes")
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.lengths = [len(self.bytes_of.get(i, b"")) for i in range(max(ranks.values()) + 1)]
        self.longest = max(self.lengths)
        self._spines: dict[int, tuple[list[int], list[int]]] = {}
        #: Pairs found to stand together, and pairs found not to.
        self.known: set[tuple[int, int]] = set()
        self._apart: set[tuple[int, int]] = set()
        self._own: dict[int, bool] = {}
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()

    def merge_down_to(self, text: bytes, parts_left: int) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals, until so many parts are left or none merges."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > parts_left:
            joined = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min(((r, i) for r, i in joined if r is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def stable(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        if (known := self._own.get(token)) is None:
            known = self._own[token] = len(self.merge_down_to(self.bytes_of[token], 1)) == 1
        return known

    def spines(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens that stand at the left and at the right end while the token is merged from bytes, in time order."""
        if (known := self._spines.get(token)) is None:
            text = self.bytes_of[token]
            if len(text) == 1:
                known = [token], [token]
            else:
                a, b = self.merge_down_to(text, 2)
                known = self.spines(self.ranks[a])[0] + [token], self.spines(self.ranks[b])[1] + [token]
            self._spines[token] = known
        return known

    def stand_together(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their joined bytes.

        Follows both merge histories at the border in rank order. The pair is
        unstable if a merge across the border comes before the next merge on
        either side (of equal ranks the left one is first).
        """
        if (pair := (a, b)) in self.known:
            return True
        if pair in self._apart:
            return False
        left, right = self.spines(a)[1], self.spines(b)[0]
        i = j = 0
        never = 1 << 62
        known = self.stable(a) and self.stable(b)
        while known:
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            if across < next_left and across <= next_right:
                known = False
            elif next_left == next_right == never:
                break
            elif next_left <= next_right:
                i += 1
            else:
                j += 1
        of = self.known if known else self._apart
        if len(of) >= MEMO_PAIRS:
            of.clear()
        of.add(pair)
        return known


class PrefixTable:
    """A piece and, for each of its byte prefixes, the last token of that prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.v, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> PrefixTable:
        """Add bytes at the end. What is stored for earlier prefixes stays as it is."""
        begin = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        # tokens that end in the new part may begin in the old one
        back = max(0, begin - self.v.longest)
        self._fill(begin, self.v.ending.iter(self.text[back:].decode("latin-1")), back)
        return self

    def _fill(self, begin: int, found: Iterable[tuple[int, int]], shift: int = 0) -> None:
        last, length, together = self.last, self.v.lengths, self.v.stand_together
        for end, token in found:
            end += shift + 1
            if end <= begin or last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0:
                if self.v.stable(token):
                    last[end] = token
            elif together(last[start], token):
                last[end] = token

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put new bytes in place of [start, end). Prefixes up to start stay; later ones are filled again until they meet the old ones.

        A prefix's last token depends on those of the prefixes up to one longest token before it. So where a longest
        token's length of prefixes, behind the edit, end as they ended before, all that follow do too.
        """
        old, longest, shift = self.last, self.v.longest, len(new) - (end - start)
        text, behind = self.text[:start] + new + self.text[end:], start + len(new)
        low = max(0, start - longest)
        fresh, at = old[low : start + 1], start  # of the prefixes from low on
        length, together, ending = self.v.lengths, self.v.stand_together, self.v.ending
        while at < len(text):
            to = min(len(text), max(at, behind) + 4 * longest)
            back = max(low, at - longest)
            fresh += [-1] * (to - at)
            for place, token in ending.iter(text[back:to].decode("latin-1")):
                stop = place + back + 1
                if stop <= at or fresh[stop - low] >= 0:
                    continue
                begin = stop - length[token]
                if begin == 0:
                    if self.v.stable(token):
                        fresh[stop - low] = token
                elif together(fresh[begin - low], token):
                    fresh[stop - low] = token
            at = to
            if at - longest > behind and fresh[at - longest + 1 - low : at + 1 - low] == old[at - longest + 1 - shift : at + 1 - shift]:
                break
        self.text = text
        old[start + 1 : at - shift + 1] = fresh[start + 1 - low : at + 1 - low]
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(token := self.last[at])
            at -= self.v.lengths[token]
        return out[::-1]


class Encoder:
    """Whole texts. ``pattern`` cuts a text into pieces that are encoded one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.v = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self._chunks: dict[str, tuple[bytes, bytes]] = {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token as a whole is that token.

        The same table as ``PrefixTable`` fills, written out for the many short pieces of a corpus.
        """
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, known, together = self.v.lengths, self.v.known, self.v.stand_together
        last = [-1] * (len(piece) + 1)
        for end, token in self.v.ending.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if not start:
                    if self.v.stable(token):
                        last[end] = token
                elif (pair := (last[start], token)) in known or together(*pair):
                    last[end] = token
        out, at = [], len(piece)
        while at:
            out.append(token := last[at])
            at -= length[token]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in CHUNK.findall(text or "") for p in self.split(chunk) for i in self.piece(p.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Of a chunk: its ids as ``id,`` in decimal, and the bytes that they decode to."""
        ids = [i for p in self.split(chunk) for i in self.piece(p.encode())]
        return ("%d," * len(ids) % tuple(ids)).encode(), self.decode(ids)

    def texts(self, text: str | None) -> tuple[bytes, bytes]:
        """All ids in decimal, each with a comma behind it, and the decoded bytes."""
        chunks, memo = CHUNK.findall(text or ""), self._chunks
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        try:
            pairs = list(map(memo.__getitem__, chunks))
        except KeyError:
            pairs = []
            for chunk in chunks:
                if (known := memo.get(chunk)) is None:
                    known = self._chunk(chunk)
                    if len(chunk) <= 64:
                        memo[chunk] = known
                pairs.append(known)
        return b"".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes."""
        ids, decoded = self.texts(text)
        return ids.count(b","), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(token_file: tuple[str, bytes], pattern: str) -> Encoder:
    """This worker's encoder for a broadcast vocabulary file; built once and used by all its tasks."""
    key = (token_file[0], pattern)
    if key not in _encoders:
        lines = (x.split() for x in token_file[1].splitlines() if x.strip())
        _encoders[key] = Encoder({base64.b64decode(t): int(r) for t, r in lines}, pattern)
    return _encoders[key]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file for all workers. A tokenizer file has a fixed size of about 1 MB; over 64 MB is refused."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary: {len(content)} bytes")
    return spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def _map(docs: DataFrame, text: str, rows, added: T.StructType) -> DataFrame:
    """Each Arrow batch of docs with the columns that ``rows(texts)`` gives for its texts, in order."""
    import pyarrow as pa

    schema = T.StructType([*docs.schema.fields, *added.fields])
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in it:
            more = rows(batch.column(at).to_pylist())
            given = [batch.column(i).cast(out.field(i).type) for i in range(batch.num_columns)]
            made = [pa.array(values, out.field(batch.num_columns + i).type) for i, values in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*given, *made], schema=out)

    return by_place(docs).mapInArrow(batches, schema)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int> in a new column ``ids``.

    Null and empty texts get an empty array. The new column's name must be free.
    """
    refuse_taken(docs, ids)
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def rows(texts):
        import numpy as np

        coder = worker_encoder(shared.value, pattern)
        return ([np.fromstring(coder.texts(t)[0].decode(), np.int32, sep=",") if t else [] for t in texts],)

    return _map(docs, text, rows, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text; the ids themselves don't leave the worker."""
    refuse_taken(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def rows(texts):
        coder = worker_encoder(shared.value, pattern)
        found = [coder.digest(t) for t in texts]
        return tuple(zip(*found)) if found else ((), (), ())

    return _map(docs, text, rows, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
