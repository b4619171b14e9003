"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

A CGK walk reads a word sequence with a pointer that stays or advances at each
step by a random bit drawn for the step and the word under the pointer. The words
read at the steps are the embedding: sequences that few edits part agree at most
steps, so edit distance becomes Hamming distance. Here every word of a document
starts a walk, that is an item-sized window, and a walk's embedding is sampled at
``SAMPLES`` steps (bit sampling). Windows whose sample equals an item's are candidates;
they are confirmed by the exact edit distance of the item to its best place near the window.

This is repeated by independent walks, and within a walk by entering each item at
every ``STRIDE`` words, the windows that begin inside it: an edit that one sample
meets, another one misses. Together they reach ``target_recall`` for passages with the
whole ``share`` of their words edited.

Items of fewer than ``WALK_WORDS`` words give a walk too few words to sample. They are
found by pieces, without loss: of one piece more than the share allows edits, one piece at
least is unedited, so every place of a piece in a text is a candidate.

The random bits repeat every ``PERIOD`` steps. Then the pointers after PERIOD steps, of
all windows of a batch at once, are one array, and any later multiple of it is
that array applied to itself. Sampled steps are such multiples. Only windows that pass
two early steps are looked at further, with a third one. All three are drawn for each walk.

Words are runs other than ASCII white space, A-Z lowered, without the marks in
``MARKS``; in scripts that don't part words each character is one. Defined results: null or
empty texts and items hold nothing; an item so short that the share allows it no edit is found
where it stands unedited. Equal items are searched once and each give their rows. The items are
sent to all workers in blocks of at most ``BLOCK_BYTES``, each block searched over all
documents; documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, hash128, quoted, written

MARKS = b".,;:!?\"()[]"
PERIOD = 4
SAMPLES = 3
#: Shorter items are found by pieces, of which so many words at most are looked up.
WALK_WORDS = 32
PIECE_WORDS = 8
#: Items are entered at every so many words, if so many are left.
STRIDE = 4
LEAST_REST = 16
#: What is sampled: two early steps and one of the others.
EARLY_STEPS, STEPS = (0, 4, 8, 12), (0, 4, 8, 12, 16, 20)
BLOCK_BYTES = 16 << 20
#: What a walk may read behind the last word.
PAD = 256
#: Words in a cache-sized block of the walk.
BLOCK_WORDS = 1 << 15
#: One entry of a walk finds a passage with a chance of (1 - share) to this power. Measured on items of WALK_WORDS words, the hardest: 3.9 at a share of 0.1, 4.7 at 0.2, 4.3 at 0.3.
ENTRY_POWER = 4.7


#: Characters of scripts that don't part words: Thai to Khmer, kana, Han.
UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = UNPARTED.sub(r" \g<0> ", text)
    return text.encode().lower().translate(None, MARKS).split()


def walks_for(target_recall: float, share: float) -> int:
    """Walks that find the target share of passages with ``share`` of their words edited. Entries of one walk overlap, so only one of them is counted on."""
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - (1 - share) ** ENTRY_POWER))) if share else 1


class Pattern:
    """An item as bit masks, one bit a word from its end: a column of the edit matrix is two integers (Myers)."""

    def __init__(self, item: list[bytes]):
        self.n, self.at = len(item), {}
        for i, word in enumerate(reversed(item)):
            self.at[word] = self.at.get(word, 0) | 1 << i

    def best_place(self, window: list[bytes]) -> tuple[int, int]:
        """Least word edits that turn the item into some run of the window, and where the first such run begins.

        Both are read backwards, so that the end of a match is where it begins.
        """
        n, all_, top = self.n, (1 << self.n) - 1, 1 << self.n >> 1
        up, down, edits = all_, 0, n
        best = n, len(window)
        for j in range(len(window) - 1, -1, -1):
            same = self.at.get(window[j], 0)
            vertical = same | down
            same |= (((same & up) + up) ^ up) & all_
            more, less = down | (all_ & ~(same | up)), up & same
            edits += bool(more & top) - bool(less & top)
            more, less = more << 1 & all_, less << 1 & all_
            up, down = less | (all_ & ~(vertical | more)), more & vertical
            if edits <= best[0]:
                best = edits, j
        return best


def edits_at_best_place(item: list[bytes], window: list[bytes]) -> tuple[int, int]:
    """``Pattern.best_place`` of an item."""
    return Pattern(item).best_place(window) if item else (0, 0)


@dataclass
class Items:
    """A block of items, prepared on the driver: words and bucket keys. Sent to every worker."""

    ids: list
    words: list[list[bytes]]
    walks: int
    share: float

    def __post_init__(self):
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(20250))
        self.seeds = draw.integers(1 << 62, 1 << 63, (self.walks, 2), np.uint64) | np.uint64(1)
        self.factors = draw.integers(1 << 62, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
        self.distinct = [frozenset(w) for w in self.words]
        self.patterns: dict[int, Pattern] = {}
        self.piece_factors = draw.integers(1 << 62, 1 << 63, PIECE_WORDS, np.uint64) | np.uint64(1)
        self.pieces = self._pieces()
        #: For each walk its two early steps and its third one.
        self.early, self.late = [], []
        for _ in range(self.walks):
            early = sorted(draw.choice(EARLY_STEPS, 2, replace=False).tolist())
            self.early.append(early)
            self.late.append(int(draw.choice([s for s in STEPS if s not in early])))
        long = [(i, np.concatenate([hashed(w), np.zeros(PAD, np.uint64)])) for i, w in enumerate(self.words) if len(w) >= WALK_WORDS]
        self.passes, self.tables = [], []
        for walk in range(self.walks if long else 0):
            steps, found = [*self.early[walk], self.late[walk]], []
            first = np.zeros(1 << 20, bool)
            for i, hashes in long:
                n = len(hashes) - PAD
                pointers, enter = self.pointers(hashes, walk), np.arange(0, n - LEAST_REST + 1, STRIDE)
                enter = enter[np.max([pointers[s][enter] for s in steps], axis=0) < n]
                half = self.early_key(hashes, pointers, walk)[enter]
                first[(half >> np.uint64(44)).astype(np.int64)] = True
                found.append((half + hashes[pointers[steps[2]][enter]] * self.factors[2], np.full(len(enter), i), enter))
            keys, items, offsets = (np.concatenate(of) for of in zip(*found))
            order = np.lexsort((offsets, items, keys))
            self.passes.append(first)
            self.tables.append((keys[order], items[order], offsets[order]))

    def _pieces(self) -> dict[int, tuple]:
        """For each number of words: a filter of keys, the keys of pieces in order, their items and places in them."""
        import numpy as np

        rows: dict[int, list] = {}
        for i, found in enumerate(self.words):
            n = len(found)
            if 0 < n < WALK_WORDS:
                pieces = min(int(self.share * n) + 1, n)
                size = min(n // pieces, PIECE_WORDS)
                keys = self.piece_keys(np.concatenate([hashed(found), np.zeros(PAD, np.uint64)]), [size])[size]
                rows.setdefault(size, []).extend((int(keys[at]), i, at) for at in (j * n // pieces for j in range(pieces)))
        out = {}
        for size, of in rows.items():
            of.sort()
            known = np.array([r[0] for r in of], np.uint64)
            passes = np.zeros(1 << 20, bool)
            passes[(known >> np.uint64(44)).astype(np.int64)] = True
            out[size] = passes, known, np.array([r[1] for r in of]), np.array([r[2] for r in of])
        return out

    def piece_keys(self, hashes, sizes) -> dict[int, object]:
        """For each number of words, the keys of the runs of so many words from each word on."""
        import numpy as np

        n, out = len(hashes) - PAD, {}
        key = np.zeros(n, np.uint64)
        for i in range(max(sizes, default=0)):
            key = key + hashes[i : i + n] * self.piece_factors[i]
            if i + 1 in sizes:
                out[i + 1] = key
        return out

    def piece_candidates(self, hashes) -> set[tuple[int, int]]:
        """(start, item) of all windows of a text that hold a piece of a short item in its place."""
        import numpy as np

        out = set()
        for size, keys in self.piece_keys(hashes, self.pieces).items():
            passes, known, items, places = self.pieces[size]
            near = np.flatnonzero(passes.take((keys >> np.uint64(44)).view(np.int64)))
            at, row = matches(known, keys[near])
            out.update(zip((near[at] - places[row]).tolist(), items[row].tolist()))
        return out

    def pointers(self, hashes, walk: int) -> dict[int, object]:
        """For each multiple of PERIOD, where the walk from each word stands after so many steps."""
        import numpy as np

        coins = ((hashes ^ self.seeds[walk, 0]) * self.seeds[walk, 1] >> np.uint64(60)).astype(np.int64)
        coins += (coins == 0) << (PERIOD - 1)  # bits repeat, so a word without any would hold a walk for ever
        coins[-PERIOD:] = 0  # no walk leaves the array
        at = start = np.arange(len(hashes))
        for step in range(PERIOD):
            at = at + (coins >> step & 1).take(at)
        jump, out = at, {0: start}
        for step in range(PERIOD, max(STEPS) + 1, PERIOD):
            out[step] = at
            at = jump.take(at)
        return out

    def early_key(self, hashes, pointers, walk: int):
        a, b = self.early[walk]
        first = hashes if a == 0 else hashes.take(pointers[a])
        return first * self.factors[0] + hashes.take(pointers[b]) * self.factors[1]

    def candidates(self, hashes) -> set[tuple[int, int]]:
        """(start, item) of all windows of a text that hold a piece of a short item or meet an item in some walk."""
        import numpy as np

        out = self.piece_candidates(hashes)
        for walk in range(len(self.tables)):
            pointers = self.pointers(hashes, walk)
            half = self.early_key(hashes, pointers, walk)
            near = np.flatnonzero(self.passes[walk].take((half >> np.uint64(44)).view(np.int64)))
            half = half[near]
            known, items, offsets = self.tables[walk]
            at, row = matches(known, half + hashes.take(pointers[self.late[walk]].take(near)) * self.factors[2])
            out.update(zip((near[at] - offsets[row]).tolist(), items[row].tolist()))
        return out

    def confirm(self, words: list[bytes], start: int, item: int) -> tuple[int, int] | None:
        """(edits, start) of the item near a place in a text's words, if within the allowed share."""
        own = self.words[item]
        n = len(own)
        start = max(0, start)
        if words[start : start + n] == own:
            return 0, start
        most = int(self.share * n)
        begin = max(0, start - most)
        window = words[begin : start + n + most]
        # each of its words that the window lacks takes an edit
        if len(self.distinct[item]) - len(self.distinct[item].intersection(window)) > most:
            return None
        if item not in self.patterns:
            self.patterns[item] = Pattern(own)
        edits, place = self.patterns[item].best_place(window)
        return (edits, begin + place) if edits <= most else None

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item, start word, edits): for each text and item the best place, the first among equals."""
        import numpy as np

        pending: list[tuple[int, list[bytes]]] = []
        size = 0

        def flush():
            hashes = np.concatenate([hashed(w) for _, w in pending] + [np.zeros(PAD, np.uint64)])
            begins = np.cumsum([0] + [len(w) for _, w in pending])
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for at, item in self.candidates(hashes):
                # a window entered inside the item may name a start before its text's first word: the text is that of its middle
                of = int(np.searchsorted(begins, at + len(self.words[item]) // 2, "right")) - 1
                for of in {of, int(np.searchsorted(begins, at, "right")) - 1}:
                    if 0 <= of < len(pending):
                        number, own = pending[of]
                        if (found := self.confirm(own, at - int(begins[of]), item)) is not None:
                            best[number, item] = min(best.get((number, item), found), found)
            yield from ((number, item, start, edits) for (number, item), (edits, start) in sorted(best.items()))

        for number, text in enumerate(texts):
            if found := words_of(text):
                pending.append((number, found))
                size += len(found)
            if size >= BLOCK_WORDS:
                yield from flush()
                pending, size = [], 0
        if pending:
            yield from flush()


def matches(known, keys):
    """Pairs of places in ``keys`` and in the ordered ``known`` that hold the same key."""
    import numpy as np

    first = np.searchsorted(known, keys)
    hit = np.flatnonzero(known.take(first, mode="clip") == keys)
    first, last = first[hit], np.searchsorted(known, keys[hit], "right")
    times = last - first
    return np.repeat(hit, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


def hashed(words: list[bytes]):
    """Numbers that stand for words in a walk. Equal numbers of unequal words only give candidates that don't hold."""
    from zlib import crc32

    import numpy as np

    return np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)


def _blocks(items: DataFrame, text: str, target_recall: float, share: float) -> Iterator:
    """The distinct item texts, broadcast in blocks of a bounded size, each with whether there are others; a text is known by its hash.

    A block is made when it is asked for. Where there are several, whoever asks saves what a block has found and lets go of it before the next.
    """
    spark = items.sparkSession
    own = items.select(F.col(quoted(text)).alias("text")).where("text is not null").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for block in range(n):
        rows = own.where(part == block).select(hash128(F.col("text")).alias("k"), "text").collect()  # at most about BLOCK_BYTES
        yield n > 1, spark.sparkContext.broadcast(Items([bytes(r["k"]) for r in rows], [words_of(r["text"]) for r in rows], walks_for(target_recall, share), share))


def find_leaks(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", target_recall: float = 0.95, share: float = 0.2) -> DataFrame:
    """One row per document row and item found in it: id, item_id, start_word, item_words, edits, similarity.

    An item is found where at most ``share`` of its words need an edit.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[id].dataType), *T._parse_datatype_string("k binary, start_word bigint, item_words bigint, edits bigint, similarity double").fields])

    def search(shared):
        def batches(it: Iterator) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            block, out = shared.value, to_arrow_schema(schema)
            for batch in it:
                rows = list(block.leaks(batch.column(1).to_pylist()))
                sizes = [len(block.words[i]) for _, i, _, _ in rows]
                columns = [
                    batch.column(0).take(pa.array([n for n, *_ in rows], pa.int64())), [block.ids[i] for _, i, _, _ in rows], [s for _, _, s, _ in rows],
                    sizes, [e for *_, e in rows], [1 - e / n for (*_, e), n in zip(rows, sizes)],
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        return docs.select(F.col(quoted(id)), F.col(quoted(text))).mapInArrow(batches, schema)

    parts = []
    for several, shared in _blocks(items, item_text, target_recall, share):
        parts.append(written(search(shared), "leaks") if several else search(shared))
        if several:
            shared.unpersist()
    found = reduce(DataFrame.unionAll, parts)
    named = items.select(F.col(quoted(item_id)).alias("item"), hash128(F.col(quoted(item_text))).alias("k"))
    return found.join(named, "k").select(F.col("doc").alias(id), F.col("item").alias(item_id), "start_word", "item_words", "edits", "similarity")


def without_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", target_recall: float = 0.95, share: float = 0.2) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    names, at = docs.columns, docs.columns.index(text)

    def keep(df: DataFrame, shared) -> DataFrame:
        def batches(it: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in it:
                hit = {n for n, *_ in shared.value.leaks(batch.column(at).to_pylist())}
                left = batch.filter(pa.array([n not in hit for n in range(batch.num_rows)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(left.columns, names=names)

        return by_place(df).mapInArrow(batches, df.schema)

    for several, shared in _blocks(items, item_text, target_recall, share):
        docs = written(keep(docs, shared), "clean") if several else keep(docs, shared)
        if several:
            shared.unpersist()
    return docs
