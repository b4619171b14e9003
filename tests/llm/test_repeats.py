"""Repeated strings against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.llm import repeats
from lodestep.llm.common import P


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(1 for a, b in zip(b"\0" + gone, gone) if b > a), hashlib.sha256(left).hexdigest()))
    return out


def found(docs, size):
    out = repeats.without_repeats(docs, threshold=size)
    return [tuple(r) for r in out.orderBy("doc_id").select(*(P + c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))).collect()]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def planted():
    """Random texts with passages of all lengths about the threshold, at odd places, edited here and there; runs and periods."""
    rng = random.Random(11)
    noise = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    passages = [noise(rng.randrange(30, 200)) for _ in range(12)]
    texts = [noise(rng.randrange(0, 300)) for _ in range(40)]
    for _ in range(60):
        p = rng.choice(passages)
        a = rng.randrange(len(p) // 2)
        piece = list(p[a : a + rng.randrange(20, 200)])
        for _ in range(rng.randrange(3)):
            piece[rng.randrange(len(piece))] = "#"
        texts.append(noise(rng.randrange(90)) + "".join(piece) + noise(rng.randrange(90)))
    texts += ["é" * 90, "x" * 400, "x" * 41, "ab" * 200, "abc" * 100 + noise(9), noise(500, "ab"), noise(700, "ab"), texts[50], texts[50], "short", "", None]
    return texts


def test_equals_brute_force(spark, planted):
    assert found(table(spark, planted), 40) == brute(planted, 40)
    assert found(table(spark, planted), 75) == brute(planted, 75)


def test_a_pair_over_several_partitions(spark):
    texts = ["x" * 3000, "y" * 50 + "x" * 500, *("z" * i for i in range(30, 60))]
    assert found(table(spark, texts), 32) == brute(texts, 32)


def test_odd_rows(spark, odd_docs, odd_extra, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    want = sorted(brute(texts, 40))
    for docs in (odd_docs, odd_extra):
        out = repeats.without_repeats(docs, threshold=40)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert sorted(tuple(r) for r in out.select(*(P + c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))).collect()) == want
    assert repeats.without_repeats(no_docs).count() == 0
    assert found(table(spark, ["abc" * 9, "q"]), 400) == brute(["abc" * 9, "q"], 400)


def test_ranks_are_those_of_the_doubled_strings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(600)) for _ in range(6)]
    texts.append(texts[0][100:500] + "c" + texts[1][:300])
    df = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "h long, h2 long, text string")
    k, w = repeats.window(64)
    for level, ranks in enumerate(repeats.levels(df, 64, repeats.Tables(spark))):
        by_rank = {}
        for r in ranks.collect():
            by_rank.setdefault(r["rank"], []).append(texts[r["h"]][r["begin"] : r["end"]])
        assert all(len(v) > 1 and len(set(v)) == 1 for v in by_rank.values())
        assert len({v[0] for v in by_rank.values()}) == len(by_rank), level
        spread = [tuple(r) for r in ranks.groupBy("h", "i").count().where("count > 1").collect()]
        assert not spread


def test_sampled_places_are_chosen_by_content():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 101, 500).astype(np.uint8)
    k, w = repeats.window(100)
    a, b = (np.concatenate([rng.integers(97, 101, n).astype(np.uint8), shared, rng.integers(97, 101, 50).astype(np.uint8)]) for n in (37, 411))
    chosen = []
    for data, at in ((a, 37), (b, 411)):
        _, s, x = repeats.sampled(data, np.array([0, len(data)]), k, w)
        x = x - at
        inside = np.searchsorted(s, at, side="right") - 1
        chosen.append([v for v in x[inside:] if v < 500 - k - w])
    assert chosen[0] == chosen[1] and len(chosen[0]) > 5
    _, s, x = repeats.sampled(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), k, w)
    assert len(x) == sum(len(repeats.sampled(d, np.array([0, len(d)]), k, w)[0]) for d in (a, b))


def test_query_on_a_whole_table(spark, sf):
    from lodestep.llm import queries

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r)[1:] for r in queries.op13_repeated_strings(spark, sf).orderBy("doc_id").collect()]
    assert got == brute(texts, 400)
