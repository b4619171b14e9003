"""The pipeline against brute force over the smallest tables, stage by stage."""

import hashlib

import corpus_pipeline
from lodestep.llm import decontaminate, queries
from lodestep.llm.common import table

from .test_operators import counts_by_hand, groups_by_hand, lines_by_hand


def test_stages(spark, sf):
    import tiktoken

    from lodestep.llm import bpe

    docs = table(spark, sf, "documents")
    path, pattern = queries.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    items = [decontaminate.words_of(r.text) for r in table(spark, sf, "benchmark").collect()]

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    first = stages["quality_rules"](spark, docs, sf)
    assert first.columns == docs.columns
    texts = {r.doc_id: r.text for r in first.collect()}
    assert all(not counts_by_hand(t)[-1] for t in texts.values())

    second = stages["line_dedup"](spark, first, sf)
    assert second.columns == docs.columns
    expected = dict(zip(texts, lines_by_hand(list(texts.values()), 10)))
    texts = {r.doc_id: r.text for r in second.collect()}
    assert texts == expected

    third = stages["near_dedup"](spark, second, sf)
    assert third.columns == docs.columns
    groups = groups_by_hand(texts, 5, 80)
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    assert {r.doc_id: r.text for r in third.collect()} == texts

    fourth = stages["decontamination"](spark, third, sf)
    assert fourth.columns == docs.columns
    left = {r.doc_id: r.text for r in fourth.collect()}
    whole = lambda w: b" " + b" ".join(w) + b" "
    leaked = {k for k, t in texts.items() if any(whole(i) in whole(decontaminate.words_of(t)) for i in items)}
    assert not leaked & set(left)
    for k in set(texts) - set(left) - leaked:  # near copies: at most a fifth of an item's words are edited
        own = decontaminate.words_of(texts[k])
        assert any(decontaminate.edits_at_best_place(i, own)[0] <= 0.2 * len(i) for i in items)

    last = stages["byte_bpe"](spark, fourth, sf).collect()
    assert {r.doc_id for r in last} == set(left)
    for r in last:
        ids = library.encode_ordinary(left[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_run_is_its_stages(spark, sf):
    """run() over a whole folder equals the stages one after the other."""
    df = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, df.collect()))


def test_stages_on_odd_rows(spark, sf, odd_extra, no_docs):
    for docs in (odd_extra, no_docs):
        df = docs
        for name, stage in corpus_pipeline.STAGES[:4]:
            df = stage(spark, df, sf)
            assert df.columns == docs.columns, name
        assert corpus_pipeline.byte_bpe(spark, df, sf).count() == df.count()
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_one_of_repeated_rows_stays(spark, sf, odd_extra):
    """Rows that agree in everything are one group; rows without words all stay; columns with odd names are kept."""
    left = corpus_pipeline.near_dedup(spark, odd_extra, sf)
    assert left.columns == odd_extra.columns
    texts = [r.text for r in left.collect()]
    assert sum((t or "").startswith("the quick brown fox") for t in texts) == 1
    twice = corpus_pipeline.near_dedup(spark, odd_extra.where("doc_id = 7").unionByName(odd_extra.where("doc_id in (4, 5)")), sf)
    assert sorted(r.doc_id for r in twice.collect()) == [4, 5, 7]
