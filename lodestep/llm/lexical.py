"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector of term weights, an item a sparse vector of idf weights; a score is
their inner product, in integers. Tasks put the documents they read into ball trees of at most ``TREE``
documents: nodes split at the median along the line between two far documents down to ``LEAF`` documents, and
have a centroid, a radius and the terms that occur in them. For an item q no document of a node scores over

    q . centroid + |q restricted to the node's terms| * radius

(Cauchy-Schwarz on the difference to the centroid; both are 0 outside the node's terms). Bounds are
computed in doubles and widened by more than their rounding errors, so that they hold for the integers. Subtrees
are visited best bound first, until the best is below the item's k-th score so far;
leaves are scored exactly in 64-bit integers. A bound that equals the k-th score is visited: ties go by id.

Items are taken in blocks of ``BLOCK``: only terms of a block's items matter to it, so vectors hold no
others. Item counts are what is broadcast. The k-th scores over a sample of documents (one in ``SAMPLE``, by hash)
start off the search; as documents of the sample are documents too, they only save visits. Each task
returns k documents an item at most.

Terms are maximal runs of ASCII letters and digits and everything beyond ASCII; A-Z are lowered. Defined results: texts
without a term, or null, aren't documents; items without a term find nothing. Rows with equal
ids are documents of their own, null ids come last among equal scores.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import in_order
from .common import P, quoted, written

BLOCK, TREE, LEAF, SAMPLE = 2_048, 4_096, 32, 64
#: Rows of a chunk of counted documents that goes back to Spark.
ROWS = 2_000
#: Factor and summand by which bounds are widened: sums of doubles here err by less than 1e-11 of their size.
WIDER, MORE = 1 + 1e-9, 1.0
#: Separators become spaces, A-Z a-z. What is beyond ASCII stays.
_TERMS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def counted(docs: DataFrame, words: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """(id, n, term, tf) of each document with a term: its length in terms, and the terms of ``words`` with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        number = known.value
        for batch in it:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, lengths, numbers, counts = [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                    if own := terms(t.as_py()):
                        found = Counter(x for x in map(number.get, own) if x is not None)
                        ids.append(i)
                        lengths.append(len(own))
                        numbers.append(list(found))
                        counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "term", "tf"])

    named = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    return named.mapInArrow(batches, "id bigint, n bigint, term array<int>, tf array<bigint>")


class BallTree:
    """A tree over rows of a sparse integer matrix (starts of rows, columns, values), scaled by ``scale`` for the geometry."""

    def __init__(self, starts, columns, values, scale):
        import numpy as np

        self.np, width = np, len(scale)
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        self.radius: list[float] = []
        centre_of, centre_at, centre_v = [], [], []
        order = np.arange(len(starts) - 1)
        scratch = np.zeros(width)
        scaled = values * scale[columns]
        sizes = np.diff(starts)

        def rows(ix):
            """Places of the entries of rows ``ix``, and the row number, from 0, of each."""
            n = sizes[ix]
            at = np.repeat(starts[ix] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            return at, np.repeat(np.arange(len(ix)), n)

        def dot(at, of, n, where, v):
            scratch[where] = v
            out = np.bincount(of, weights=scaled[at] * scratch[columns[at]], minlength=n)
            scratch[where] = 0.0
            return out

        def entries(i):
            return columns[starts[i] : starts[i + 1]], scaled[starts[i] : starts[i + 1]]

        squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=scaled * scaled, minlength=len(sizes))

        def node(lo: int, hi: int) -> int:
            number = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append(None)
            self.radius.append(0.0)
            ix = order[lo:hi]
            at, of = rows(ix)
            sums = np.bincount(columns[at], weights=scaled[at], minlength=1)
            support = np.unique(columns[at])
            mean = sums[support] / (hi - lo)
            centre_of.append(support)
            centre_at.append(np.full(len(support), number))
            centre_v.append(mean)
            away = squares[ix] - 2 * dot(at, of, len(ix), support, mean) + float(mean @ mean)
            # the squares above cancel: an error of theirs is small beside the norms, not beside the distance
            slack = 1e-11 * (float(squares[ix].max(initial=0.0)) + float(mean @ mean))
            self.radius[number] = math.sqrt(max(float(away.max(initial=0.0)), 0.0) + slack) * WIDER
            if hi - lo > LEAF and self.radius[number] > math.sqrt(slack) * 2:
                one = ix[int(away.argmax())]
                off = squares[ix] - 2 * dot(at, of, len(ix), *entries(one)) + squares[one]
                two = ix[int(off.argmax())]
                along = dot(at, of, len(ix), *entries(one)) - dot(at, of, len(ix), *entries(two))
                order[lo:hi] = ix[np.argsort(along, kind="stable")]
                middle = (lo + hi) // 2
                self.children[number] = node(lo, middle), node(middle, hi)
            return number

        node(0, len(order))
        at, _ = rows(order)
        self.order, self.starts = order, np.concatenate([[0], np.cumsum(sizes[order])])
        self.columns, self.values = columns[at], values[at]
        self.radius = np.array(self.radius)
        term, where, value = map(np.concatenate, (centre_of, centre_at, centre_v))
        by_term = np.argsort(term, kind="stable")
        self.where, self.value = where[by_term], value[by_term]
        self.upto = np.searchsorted(term[by_term], np.arange(width + 1))
        self.lookup = np.zeros(width, dtype=np.int64)
        self.scored = 0

    def bounds(self, columns, q):
        """An upper bound of the item with ``q`` (unscaled by the tree's scale) for each node."""
        np = self.np
        n = self.upto[columns + 1] - self.upto[columns]
        at = np.repeat(self.upto[columns] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own = np.repeat(q, n)
        nodes = self.where[at]
        centre = np.bincount(nodes, weights=own * self.value[at], minlength=len(self.radius))
        norm = np.bincount(nodes, weights=own * own, minlength=len(self.radius))
        return (centre + np.sqrt(norm) * self.radius) * WIDER + MORE

    def search(self, columns, weights, q, take, least) -> None:
        """Give ``take(rows, scores)`` the documents of every leaf whose bound isn't below ``least()``, best bounds first."""
        np = self.np
        bound = self.bounds(columns, q)
        self.lookup[columns] = weights
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least():
            _, number = heapq.heappop(heap)
            if self.children[number]:
                for child in self.children[number]:
                    heapq.heappush(heap, (max(-bound[child], _), child))  # a part has no more than the whole
                continue
            lo, hi = self.spans[number]
            a, b = self.starts[lo], self.starts[hi]
            if a == b:
                continue
            self.scored += hi - lo
            gained = np.concatenate([[0], np.cumsum(self.values[a:b] * self.lookup[self.columns[a:b]])])
            take(self.order[lo:hi], gained[self.starts[lo + 1 : hi + 1] - a] - gained[self.starts[lo:hi] - a])
        self.lookup[columns] = 0


def _found(vectors: DataFrame, items: list, weight: list[int], documents: int, total: int, k: int, floor: dict[int, int]) -> DataFrame:
    """(item, id, score): each task's k best documents of each item. ``items`` are (number, {term: count}); ``floor`` has scores that k documents reach."""
    known = vectors.sparkSession.sparkContext.broadcast((items, weight, floor))

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        items, weight, floor = known.value
        w = np.array(weight, dtype=np.int64)
        scale = np.sqrt(np.maximum(w, 1).astype(float))
        asked = []
        for number, counts in items:
            columns = np.array(sorted(counts), dtype=np.int64)
            own = np.array([counts[c] for c in columns.tolist()], dtype=np.int64) * w[columns]
            asked.append((number, columns, own, own / scale[columns]))
        best: list[list] = [[] for _ in asked]

        def searched(ids, lengths, term, tf) -> None:
            starts = term.offsets.to_numpy().astype(np.int64)
            columns = term.values.to_numpy()[starts[0] : starts[-1]].astype(np.int64)
            times = tf.values.to_numpy()[tf.offsets[0].as_py() : tf.offsets[-1].as_py()]
            starts = starts - starts[0]
            m = 25 + (75 * lengths.to_numpy() * documents) // total
            values = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, np.diff(starts)))
            tree = BallTree(starts, columns, values, scale)
            ids = ids.to_pylist()
            for heap, (number, columns, own, q) in zip(best, asked):
                start = max(floor.get(number, 1), 1)
                least = lambda: max(heap[0][0] if len(heap) == k else 1, start)  # noqa: B023, E731

                def take(rows, scores):
                    good = np.flatnonzero(scores >= least())  # noqa: B023
                    for row, score in zip(rows[good].tolist(), scores[good].tolist()):
                        entry = score, -math.inf if ids[row] is None else -ids[row], ids[row]  # noqa: B023
                        if len(heap) < k:  # noqa: B023
                            heapq.heappush(heap, entry)  # noqa: B023
                        elif entry[:2] > heap[0][:2]:  # noqa: B023
                            heapq.heapreplace(heap, entry)  # noqa: B023

                if len(columns):
                    tree.search(columns, own, q, take, least)

        held: list = []
        for batch in it:
            for start in range(0, batch.num_rows, TREE):
                part = batch.slice(start, TREE)
                held.append(part)
                if sum(x.num_rows for x in held) >= TREE:
                    together = pa.Table.from_batches(held).slice(0, TREE).combine_chunks()
                    left = pa.Table.from_batches(held).slice(TREE)
                    searched(*(together.column(i).chunk(0) for i in range(4)))
                    held = left.combine_chunks().to_batches()
        if held and (together := pa.Table.from_batches(held).combine_chunks()).num_rows:
            searched(*(together.column(i).chunk(0) for i in range(4)))
        rows = [(number, i, score) for heap, (number, *_) in zip(best, asked) for score, _, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64()))], ["item", "id", "score"])

    return vectors.mapInArrow(batches, "item bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list, k: int, text: str, doc_id: str) -> DataFrame:
    """(item, rank, id, score) of a block of (number, text)."""
    words: dict[bytes, int] = {}
    asked = [(number, dict(Counter(words.setdefault(t, len(words)) for t in terms(own)))) for number, own in items]
    vectors = written(counted(docs, words, text, doc_id), "vectors")
    documents, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one count for each term of the block's items
    df = dict(vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()) if words else {}
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))]
    matched = vectors.where(F.size("term") > 0).select("id", "n", "term", "tf")
    search = lambda rows, floor: _found(rows, asked, weight, documents, max(total, 1), k, floor)
    sample = matched.where(F.pmod(F.xxhash64("id", "n", "term"), F.lit(SAMPLE)) == 0)
    kth = _ranked(search(sample, {}), k).where(F.col("rank") == k).select("item", "score").collect()  # a row for each item at most
    return _ranked(search(matched, {r["item"]: r["score"] for r in kth}), k)


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by score and ascending id."""
    named = items.select(F.col(quoted(item_id)).alias(P + "id"), F.col(quoted(item_text)).alias(P + "text"))
    placed = written(in_order(named, [P + "id", P + "text"], P + "item"), "items")
    out = None
    for start in range(0, placed.count(), block):
        rows = placed.where((F.col(P + "item") >= start) & (F.col(P + "item") < start + block)).select(P + "item", P + "text").collect()  # a block
        found = written(_block(docs, [tuple(r) for r in rows], k, text, doc_id), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item bigint, id bigint, score bigint, rank int")
    return out.join(placed, out["item"] == placed[P + "item"]).select(F.col(P + "id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
