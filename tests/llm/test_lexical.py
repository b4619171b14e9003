"""Ranked search against scores added up term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestep.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    known = [(i, terms(t)) for i, t in docs]
    known = [(i, t) for i, t in known if t]
    n, total = len(known), sum(len(t) for _, t in known)
    df = Counter(x for _, t in known for x in set(t))
    out = []
    for item, text in items:
        asked, scores = terms(text), []
        for i, own in known:
            tf, m = Counter(own), 25 + (75 * len(own) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.ranked(d, q, **more).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "w" + str(int(rng.paretovariate(0.7)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(900)]
    docs += [(1000 + i, docs[i % 7][1].upper()) for i in range(80)]
    return docs, [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(20)]


def test_equals_brute_force(spark, corpus, monkeypatch):
    for name, small in (("TREE", 64), ("LEAF", 4), ("SAMPLE", 3)):
        monkeypatch.setattr(lexical, name, small)
    docs, items = corpus
    assert found(spark, docs, items, k=10) == brute(docs, items, 10)
    assert found(spark, docs, items[:5], k=3, block=2) == brute(docs, items[:5], 3)


def test_odd_rows(spark, odd_extra):
    docs = [(r.doc_id, r.text) for r in odd_extra.collect()]
    items = [(1, "the QUICK fox, fox!"), (1, "the quick fox, fox"), (2, None), (None, "word éclair İSTANBUL"), (3, "nowhere"), (4, " \t")]
    q = spark.createDataFrame(items, "item_id long, text string").withColumnsRenamed({"text": "n"})
    out = lexical.ranked(odd_extra, q, item_text="n", k=10)
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items, 10)


def test_empty_tables(spark, no_docs):
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(no_docs, q).collect() == []
    assert lexical.ranked(no_docs, q.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(50 * (i % 6), 50 * (i % 6) + 50, 12)) for i in range(600)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    columns = np.concatenate(rows)
    values = rng.integers(1, 10**6, len(columns))
    weights = rng.integers(1, 10**4, 300)
    scale = np.sqrt(weights.astype(float))
    tree = lexical.BallTree(starts, columns, values, scale)
    asked = np.arange(7, 45)
    bound = tree.bounds(asked, weights[asked] / scale[asked])
    exact = np.array([sum(int(v) * int(weights[c]) for c, v in zip(columns[a:b], values[a:b]) if c in set(asked.tolist())) for a, b in zip(starts, starts[1:])])
    for (lo, hi), top in zip(tree.spans, bound):
        assert exact[tree.order[lo:hi]].max() <= top
    got = {}
    tree.search(asked, weights[asked], weights[asked] / scale[asked], lambda rows, scores: got.update(zip(rows.tolist(), scores.tolist())), lambda: int(np.sort(exact)[-5]))
    assert all(got[i] == exact[i] for i in got) and set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(got)
    assert tree.scored < 200  # five of the six kinds hold no term of the item
