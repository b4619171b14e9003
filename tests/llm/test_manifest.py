"""The Merkle manifest against a tree built by loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestep.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def climb(nodes):
    """Root of the nodes and each one's siblings by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            proofs[i].append((run[: place % 8], run[place % 8 + 1 :]))
            at[i] = place // 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r.doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, ways = [], {}
    for g in order:
        own = sorted(groups[g], key=lambda x: x[:3])
        root, proofs = climb([x[2] for x in own])
        subs.append(root)
        ways[g] = own, proofs
    root, tops = climb(subs)
    out = []
    for g, sub, top in zip(order, subs, tops):
        own, proofs = ways[g]
        out += [(x[3], x[2], sub, root, sha(*(s for before, after in [*way, *top] for s in [*before, *after]))) for x, way in zip(own, proofs)]
    return sorted(out, key=str)


def found(docs, **carry):
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    out = manifest.manifest(docs, carry=carry)
    return out.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(manifest.proof_text(F.col("steps")).cast("binary"), 256).alias("p"))


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame([(i * 7 % 600, f"text Ä {i}", [None, "en", "fr", "zz"][min(i % 90, 3)], "s", i) for i in range(600)], DOCS)


def test_manifest_equals_loops(many):
    assert sorted(map(tuple, found(many).collect()), key=str) == brute(many.collect())


def test_manifest_of_odd_rows(odd_docs, odd_extra):
    want = brute(odd_docs.collect())
    assert sorted(map(tuple, found(odd_docs).collect()), key=str) == want
    assert sorted(map(tuple, found(odd_extra).collect()), key=str) == want


def test_far_ancestors_are_copied_by_chunk(many, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", 5)
    assert sorted(map(tuple, found(many).collect()), key=str) == brute(many.collect())


def test_manifest_of_few_rows(spark, no_docs):
    assert found(no_docs).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    assert [tuple(r) for r in found(one).collect()] == brute(one.collect())
    two = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", None, "s", 1)], DOCS)
    assert sorted(map(tuple, found(two).collect()), key=str) == brute(two.collect())


def test_tampering_shows(many):
    changed = F.when(F.col("doc_id") % 5 == 0, manifest.tampered(many, F.lit("other"))).otherwise(manifest.tampered(many, F.col("text")))
    out = manifest.manifest(many, carry={"given": changed})
    told = out.select("doc_id", (manifest.folded(F.col("given"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert len(told) == 600 and all(r.ok == (r.doc_id % 5 != 0) for r in told)


def test_query_on_a_whole_table(spark, sf):
    from lodestep.llm import queries

    rows = queries.op12_merkle_manifest(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows), key=str) == brute(docs)
    import zlib

    text = {r.doc_id: r.text or "" for r in docs}
    changed = lambda i: zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text[i])
    assert all(r.verified == (r.folded_root == r.root) == (not changed(r.doc_id)) for r in rows)
