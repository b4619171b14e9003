"""Each operator against a brute-force version on small tables, and on odd rows."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestep.llm import bpe, decontaminate, langid, licenses, linededup, neardup, packing, quality, queries, sharding, warc
from lodestep.llm.common import P, ascii_lower, table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


# --- shared ---


def test_ascii_lower_changes_only_ascii(spark):
    texts = ["ABC é", "É A", "İ Z", "Ⅷ Ⓐ Q", "ß", "ǅ D", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t")).alias("x"))
    expected = [t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert [r.x for r in df.collect()] == expected


# --- language ---


def test_language_held_out_accuracy(spark, sf, docs):
    rows = queries.op1_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(odd_docs, odd_extra, no_docs):
    learned = langid.learn(odd_docs)
    assert set(learned) == {"en", "fr"}
    out = langid.identify(odd_extra, learned)
    assert set(odd_extra.columns) < set(out.columns)
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert langid.learn(no_docs) == {}
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def test_language_sample_ignores_copies(spark):
    rows = [(i, "same text again", "en") for i in range(3000)] + [(9000 + i, f"text number {i} of many", "en") for i in range(50)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned["en"].count(b"same text again") <= 1


def test_language_of_copies_is_learned(spark):
    """A language of very many rows but few texts keeps its dictionary."""
    draw = random.Random(2)
    rows = [(f"das ist ein deutscher satz nummer {i % 51} mit vielen worten", "de") for i in range(20_000)]
    rows += [(" ".join(draw.choices(["the", "cat", "sat", "down", "here", "and", "there", "again"], k=9)), "en") for _ in range(2000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    learned = langid.learn(df)
    assert set(learned) == {"de", "en"} and learned["de"].count(b"deutscher") == 51
    assert langid.learn(df.repartition(13)) == learned
    with pytest.raises(ValueError, match="languages"):
        langid.learn(spark.range(500).selectExpr("cast(id as string) as lang", "'a' as text"))


def test_language_is_the_smallest_encoding(spark, sf, docs):
    """Sizes, choice and score by hand: every text compressed with every dictionary."""
    import zstandard

    learned = langid.learn(table(spark, sf, "documents").where(~langid.held_out(F.col("doc_id"))))
    coders = {n: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for n, c in learned.items()}
    for r in queries.op1_language_id(spark, sf).collect():
        text = (docs[r.doc_id].text or "").lower()
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.confident) == ("und", 0.0, False)
            continue
        sizes = sorted((sum(len(coders[n].compress(text[i : i + langid.BLOCK_CHARS].encode())) for i in range(0, len(text), langid.BLOCK_CHARS)), n) for n in coders)
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert (r.lang_pred, r.confident) == (sizes[0][1], margin >= 0.01)
        assert r.score == pytest.approx(margin / (margin + 0.05) if margin else 0.0)


# --- line dedup ---


def test_line_store_is_kept_and_opened_again(spark, tmp_path):
    """Batches by two openings of one store count like one table; merges need no shuffle."""
    draw, root = random.Random(9), f"file://{tmp_path}/store"
    batches = [[draw.randrange(60) ** 2 // 30 for _ in range(draw.randint(20, 80))] for _ in range(7)]
    seen: collections.Counter = collections.Counter()
    for i, batch in enumerate(batches):
        store = linededup.LineStore(spark, 25, root, buckets=3) if i == 0 else linededup.LineStore.open(spark, root)
        n = collections.Counter(batch)
        store.add(spark.createDataFrame(list(n.items()), "h bigint, n bigint"))
        store.save()
        seen.update(n)
        assert sorted(r.h for r in linededup.LineStore.open(spark, root).hot_hashes().collect()) == sorted(h for h, m in seen.items() if m >= 25)
    runs = [x for level in store.levels for x in level]
    plan = store._merged(runs[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.forget()


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def lines_by_hand(texts, least):
    held = collections.Counter(k for t in texts for k in {key_of(x) for x in t.split("\n")} if k)
    return ["\n".join(x for x in t.split("\n") if held[key_of(x)] < least) for t in texts]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup_is_exact(spark, batches):
    draw = random.Random(5)
    pool = ["Alpha", " alpha ", "beta\t", "Beta", "gamma", "", "  ", "Ünder", "ünder", "delta x"]
    texts = ["\n".join(draw.choice(pool) if draw.random() < 0.4 else f"own {draw.randrange(10**6)}" for _ in range(draw.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = linededup.without_common_lines(df, min_docs=6, batches=batches)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == collections.Counter((i % 50, t) for i, t in enumerate(lines_by_hand(texts, 6)))


def test_line_dedup_query(spark, sf, docs):
    by_hand = dict(zip(docs, lines_by_hand([r.text for r in docs.values()], 10)))
    for r in queries.op2_line_dedup(spark, sf).collect():
        assert r.kept_sha256 == hashlib.sha256(by_hand[r.doc_id].encode()).hexdigest()
        assert r.n_lines == docs[r.doc_id].text.count("\n") + 1


def test_line_dedup_odd(odd_extra, no_docs):
    out = linededup.without_common_lines(odd_extra, min_docs=3)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7].text == "" and rows[1].text == ""  # three rows hold this line
    assert rows[4].text is None and rows[4][P + "n_lines"] == 1 and rows[4][P + "n_dropped"] == 0
    assert out.count() == odd_extra.count()
    assert linededup.without_common_lines(no_docs).count() == 0


# --- packing ---


def test_best_fit_decreasing_equals_a_plain_search():
    draw = random.Random(3)
    for _ in range(200):
        length = draw.randint(1, 60)
        sizes = [draw.randint(1, length) for _ in range(draw.randint(0, 40))]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        rooms = []
        for size in sorted(sizes, reverse=True):
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                rooms.append(length - size)
            else:
                rooms[rooms.index(fit)] -= size
        assert sorted(rooms) == sorted(length - sum(sizes[i] for i in r) for r in rows)


def test_packing_round_trip(odd_docs):
    import numpy as np

    path, pattern = queries.vocabulary()
    packed = packing.pack_documents(odd_docs.where("doc_id is not null"), path, pattern, length=64, group_ids=200)
    coder = packing.Tokens(bpe.read_ranks(path), pattern, "<u2")
    got = collections.defaultdict(list)
    for r in packed.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 64
        for begin, end in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[begin:end].tolist() == list(range(end - begin))
    for r in packing.unpacked(packed).collect():
        got[r.doc_id].append((r.doc_offset, r.ids))
    for doc in odd_docs.where("doc_id is not null and doc_id <> 7").collect():
        joined = [i for _, ids in sorted(got[doc.doc_id]) for i in ids]
        assert joined == coder.encode(doc.text or "")


def test_packing_query_is_lossless_and_full(spark, sf, docs):
    """All ids of all documents, by the library, in their place; nearly no padding."""
    import tiktoken

    path, pattern = queries.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    packed = queries.op3_pack_tokens(spark, sf).cache()
    got = collections.defaultdict(dict)
    for r in packing.unpacked(packed).collect():
        assert r.doc_offset % 2048 == 0 and r.doc_offset not in got[r.doc_id]
        got[r.doc_id][r.doc_offset] = r.ids
    for k, r in docs.items():
        assert [x for at in sorted(got.get(k, {})) for x in got[k][at]] == library.encode_ordinary(r.text)
    used = packed.agg(F.sum("n_ids")).first()[0]
    assert used / (2048 * packed.count()) > 0.9
    packed.unpersist()


def test_packing_odd(odd_extra, no_docs):
    """Null and repeated ids are carried, repeated rows stay apart; an empty table has no rows."""
    path, pattern = queries.vocabulary()
    coder = packing.Tokens(bpe.read_ranks(path), pattern, "<u2")
    got = collections.Counter((r.doc_id, r.doc_offset, tuple(r.ids)) for r in packing.unpacked(packing.pack_documents(odd_extra, path, pattern, length=128)).collect())
    expected = collections.Counter()
    for r in odd_extra.collect():
        ids = coder.encode(r.text or "")
        expected.update((r.doc_id, i, tuple(ids[i : i + 128])) for i in range(0, len(ids), 128))
    assert got == expected
    assert packing.pack_documents(no_docs, path, pattern).count() == 0


def test_long_chunks_are_not_remembered():
    path, pattern = queries.vocabulary()
    coder = packing.Tokens(bpe.read_ranks(path), pattern, "<u2")
    import numpy as np

    text = "x" * 5000 + " word " + "漢" * 3000 + " word"
    assert np.frombuffer(coder.ids(text), "<u2").tolist() == coder.encode(text)
    assert max(map(len, [*coder.plain, *coder.spaced])) <= packing.MEMO_CHARS


# --- quality ---


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, sf, docs):
    for r in queries.op4_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts_by_hand(docs[r.doc_id].text)
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark, sf):
    kept = {r.doc_id: r.kept for r in queries.op4_quality_rules(spark, sf).where("n_words >= 10").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.doc_id in kept}
    assert all(kept[i] for i, q in labels.items() if q == 1)
    assert sum(not kept[i] for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())


def test_quality_odd(odd_extra, no_docs):
    out = quality.judged(odd_extra)
    assert out.count() == odd_extra.count()
    for r in out.collect():
        assert tuple(r[P + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts_by_hand(r.text)
    assert quality.judged(no_docs).count() == 0


PLAIN = "Some quite ordinary sentence number {} that says nothing much about anything at all today"
STRANGE = {
    "word_length": "{} " + " ".join(f"extraordinarily{i}" for i in range(14)),
    "capitals": "NUMBER {} SHOUTS WITHOUT END AT ALL THE PEOPLE WHO ARE IN THE STREET",
    "marks": PLAIN + " # * $ % & | < > # * !! ?! :-) (;)",
    "line_words": (PLAIN + " and so on, and more of it, and yet another remark. ") * 3 + " ".join(f"v{i}" for i in range(60)),
}


def test_each_fence_rejects_what_stands_out(spark):
    """Among ordinary documents each measure's strange one goes; where a source is made of such, it stays."""
    rows = [(i, PLAIN.format(i), "en", "plain") for i in range(4000)] + [(5000 + j, text.format(*[j] * 3), "en", "plain") for j, text in enumerate(STRANGE.values())]
    rows += [(10_000 * (j + 1) + i, text.format(*[i] * 3), "en", name) for j, (name, text) in enumerate(STRANGE.items()) for i in range(1500)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=["doc_id"])
    kept = {r.doc_id: r[P + "kept"] for r in out.where(~F.col(P + "base_failed")).collect()}
    assert all(kept[i] for i in range(4000)) and not any(kept[5000 + j] for j in range(len(STRANGE)) if 5000 + j in kept)
    assert sum(5000 + j in kept for j in range(len(STRANGE))) >= 3 and all(kept[i] for i in kept if i >= 10_000)


def test_small_groups_are_drawn_to_larger_ones(spark):
    """One document more never switches a fence from one rule to another."""
    def fence(n):
        sketch = [("en", "big", -200, 5000), ("en", "own", 0, n)]
        rows = [(lang, source, m, b, k) for lang, source, b, k in sketch for m in quality.MEASURES]
        df = spark.createDataFrame(rows, f"{P}lang string, {P}source string, measure string, bucket int, n long")
        return quality.thresholds(df).where(F.col(P + "source") == "own").first()["marks"]

    found = [fence(n) for n in (1, 99, 100, 101, 100_000)]
    assert found == sorted(found) and found[3] < 1.1 * found[1] and found[-1] > 1.0


def test_absent_measures_set_no_fence(spark):
    """A tenth of a script without capitals has some; none of them is rejected for that."""
    rows = [(i, " ".join(f"слово{1000 + i}{j}" for j in range(20)) + (" Latin Words" if i % 10 == 0 else " ещё слова"), "ru", "s") for i in range(500)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=["doc_id"])
    assert out.where(F.col(P + "kept")).count() == 500


def test_fences_move_with_documents(spark):
    """On documents: fences differ between groups, and the same fence for all would judge otherwise."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.written(quality.measured(docs).select("doc_id", F.col("lang").alias(P + "lang"), F.col("source").alias(P + "source"), *(P + c for c in quality.COUNTS)), "test")
    fences = quality.thresholds(quality.sketches(rows, [P + "lang", P + "source"])).toPandas()
    moved = [m for m in quality.MEASURES if fences[m].max() > 1.1 * fences[m].min()]
    assert len(fences) >= 60 and moved == list(quality.MEASURES)
    own = rows.where(~F.col(P + "base_failed")).join(spark.createDataFrame(fences), [P + "lang", P + "source"])
    beyond = lambda fence: F.greatest(*(F.coalesce(F.expr(e) > fence(m), F.lit(False)).cast("int") for m, e in quality.MEASURES.items()))
    constant = fences[list(quality.MEASURES)].median()
    told = own.select(beyond(F.col).alias("moving"), beyond(lambda m: F.lit(float(constant[m]))).alias("fixed")).toPandas()
    assert (told.moving != told.fixed).sum() >= 5 and 400 < told.moving.sum() < 1000


def test_sketches_merge(spark):
    """The sketch of all rows is the sum of the sketches of its parts, however they are cut."""
    df = spark.range(500).selectExpr("id as doc_id", "concat_ws(' ', array_repeat(concat('w', id), cast(11 + id % 40 as int))) as text", "'en' as lang", "concat('s', id % 3) as source")
    rows = quality.measured(df).withColumns({P + "lang": F.col("lang"), P + "source": F.col("source")}).withColumn(P + "base_failed", F.lit(False))
    whole = {(r.measure, r.bucket): r.n for r in quality.sketches(rows, [P + "lang"]).collect()}
    parts = collections.Counter()
    for r in quality.sketches(rows.repartition(7), [P + "lang", P + "source"]).collect():
        parts[r.measure, r.bucket] += r.n
    assert whole == dict(parts)


# --- names that are taken ---


def test_taken_names_are_refused(odd_docs, coders):
    for name in ("n_tokens", "ids_sha256"):
        with pytest.raises(ValueError, match=f"column {name} already"):
            bpe.encode_digests(odd_docs.withColumn(name, F.lit(1)), *queries.vocabulary())
    for name in ("score", "LANG_PRED", "confident"):
        with pytest.raises(ValueError, match="already"):
            langid.identify(odd_docs.withColumn(name, F.lit(1)), {"en": b"x"})
    for name in ("kept", "n_shingles", "component_id", "survivor"):
        with pytest.raises(ValueError, match=f"column {name} already"):
            neardup.near_duplicates(odd_docs.withColumn(name, F.lit(1)), carry=(name,))
    for name in ("a", "n", "text"):  # others may have any name
        assert neardup.near_duplicates(odd_docs.select("doc_id", "text", F.col("lang").alias("x" + name)), carry=("x" + name,)).columns.count("x" + name) == 1


# --- revisits ---


def records(spark, rows):
    schema = "record_id string, kind string, url string, captured_at timestamp, headers map<string,string>, body string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_revisits_as_of(spark, slices):
    import datetime

    draw = random.Random(8)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=draw.randint(0, 40))
    urls = ["http://www.a.org/x/", "https://A.org:443/x#f", "http://b.org/?b=2&a=1&utm_source=q", "http://b.org?a=1&b=2", None]
    rows = [(f"r{i}", "response" if draw.random() < 0.5 else "revisit", draw.choice(urls), at(), {"etag": draw.choice(['"1"', 'W/"1"', '"2"'])}, f"body {i}") for i in range(120)]
    canon = {urls[0]: "a.org/x", urls[1]: "a.org/x", urls[2]: "b.org?a=1&b=2", urls[3]: "b.org?a=1&b=2", None: None}
    got = {r.record_id: r for r in warc.resolve_revisits(records(spark, rows), slices).collect()}
    for name, kind, url, t, headers, _ in rows:
        if kind == "revisit":
            earlier = [(x[3], x[0], x) for x in rows if x[1] == "response" and url and canon[x[2]] == canon[url] and x[3] < t]
            r = got.pop(name)
            assert r.url_key == canon[url]
            if not earlier:
                assert r.status == "orphan" and r.source_id is None
                continue
            best = max(earlier)[2]
            same = best[4]["etag"].removeprefix("W/") == headers["etag"].removeprefix("W/")
            assert r.status == ("resolved" if same else "changed")
            assert (r.source_id, r.body) == ((best[0], best[5]) if same else (None, None))
    assert not got


def test_revisit_headers_and_repeats(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    full = ("a", "response", "http://a.org/", t, {"content-type": "text/html", "date": "old", "content-length": "9"}, "x")
    again = ("b", "revisit", "http://a.org", t + datetime.timedelta(hours=1), {"date": "new", "content-length": "0", "server": "s"}, None)
    rows = warc.resolve_revisits(records(spark, [full, full, again, again])).collect()
    assert len(rows) == 2
    assert all(r.status == "unchecked" and r.headers == {"content-type": "text/html", "date": "new", "content-length": "9"} for r in rows)
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_warc_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: \"x\"\r\n\r\nhello"
    def record(kind, name, date, block):
        return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Target-URI: http://a.org/\r\nWARC-Date: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, date, len(block), block)
    first = record(b"response", b"<1>", b"2024-01-01T00:00:00Z", http)
    second = record(b"revisit", b"<2>", b"2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n")
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(second))
    (row,) = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()
    assert (row.record_id, row.status, row.source_id, bytes(row.body)) == ("<2>", "resolved", "<1>", b"hello")


def test_warc_bodies_are_the_bytes_that_were_sent(spark, tmp_path):
    parts = []
    for i, body in enumerate((b"caf\xe9\x00\xff", b"")):
        block = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\n\r\n" + body
        parts.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nWARC-Target-URI: http://a.org/%d\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(block), block))
    (tmp_path / "one.warc").write_bytes(b"".join(parts))
    assert sorted(bytes(r.body) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [b"", b"caf\xe9\x00\xff"]


def test_revisits_without_place_or_time(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    later = t + datetime.timedelta(hours=1)
    rows = [("a", "response", "http://a.org", t, {"etag": "1"}, "x"), ("b", "response", "http://a.org", None, {"etag": "1"}, "y"), ("c", "revisit", "http://a.org", None, {"etag": "1"}, None),
        ("d", "revisit", None, later, None, None), ("e", "revisit", "http://a.org", later, {"etag": "1"}, None), (None, "response", "http://a.org", later - datetime.timedelta(minutes=1), {"etag": "1"}, "z")]
    got = {r.record_id: (r.status, r.source_id, r.body) for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert got == {"c": ("orphan", None, None), "d": ("orphan", None, None), "e": ("resolved", "a", "x")}


def test_revisit_query_by_hand(spark, sf):
    """Each page has one response and one later revisit; pages of one URL are seen as one."""
    pages = table(spark, sf, "pages").collect()
    got = queries.op5_warc_revisits(spark, sf).collect()
    assert sorted(r.record_id for r in got) == sorted(f"v{p.page_id}" for p in pages)
    for r in got:
        own = int(r.record_id[1:])
        assert r.captured_at == 1_700_000_000 + own * 60 + 7200
        if r.status == "resolved":
            body = next(p.html for p in pages if f"r{p.page_id}" == r.source_id)
            assert r.body_md5 == hashlib.md5(body.encode()).hexdigest() and r.body_bytes == len(body.encode())


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path, pattern = queries.vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coders):
    own, other = coders
    draw = random.Random(1)
    parts = list("ab  \n\t'sétß漢字🙂1٣२ \x85\xa0　\x1c.,!|#ndr") + ["the", "'re", "  ", "\n\n", "don't", "<|endoftext|>", "   "]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        ids = other.encode_ordinary(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == text.encode()
        n, a, b = own.digest(text)
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_appends_and_edits(coders):
    own, _ = coders
    draw = random.Random(2)
    plain = lambda s: [own.v.ranks[x] for x in own.v.merge_down_to(s, 1)]
    for _ in range(500):
        text = bytes(draw.choice(b"abcdetheinor \xc3\xa9") for _ in range(draw.randint(1, 40)))
        more = bytes(draw.choice(b"abcdethe") for _ in range(draw.randint(0, 9)))
        i = draw.randint(0, len(text))
        j = draw.randint(i, len(text))
        kept = bpe.PrefixTable(own.v, text)
        before = list(kept.last)
        assert kept.append(more).ids() == plain(text + more) and kept.last[: len(before)] == before
        assert bpe.PrefixTable(own.v, text).replace(i, j, more).ids() == plain(text[:i] + more + text[j:])


def test_bpe_edits_touch_their_neighbourhood(coders):
    """In a long piece an edit gives the table that filling it anew gives, in a small part of the time."""
    import time

    own, _ = coders
    draw = random.Random(3)
    text = bytes(draw.choice(b"abcdetheinorstu \xc3\xa9") for _ in range(200_000))
    begun = time.perf_counter()
    table = bpe.PrefixTable(own.v, text)
    built = time.perf_counter() - begun
    for i, j, new in ((70, 71, b"q"), (0, 0, b"the"), (0, 3, b""), (100_000, 100_050, b"x" * 300), (199_990, 199_999, b"end"), (5, 150_000, b"short")):
        begun = time.perf_counter()
        table.replace(i, j, new)
        took = time.perf_counter() - begun
        text = text[:i] + new + text[j:]
        fresh = bpe.PrefixTable(own.v, text)
        assert table.text == text and table.last == fresh.last
        assert took < built / 20
    short = bpe.PrefixTable(own.v, b"abcthe").replace(0, 6, b"")
    assert short.ids() == [] and short.replace(0, 0, b"the").ids() == bpe.PrefixTable(own.v, b"the").ids()


def test_bpe_query_and_odd(spark, sf, docs, coders, odd_extra, no_docs):
    _, other = coders
    for r in queries.op6_byte_bpe(spark, sf).collect():
        ids = other.encode_ordinary(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    for r in bpe.encode_documents(odd_extra, *queries.vocabulary()).collect():
        assert r.ids == other.encode_ordinary(r.text or "")
    assert bpe.encode_digests(no_docs, *queries.vocabulary()).count() == 0


# --- licenses ---


def licenses_by_hand(text):
    words = licenses.words_in(text or "")
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    more, part = set(), 0.0
    for b in range(0, max(1, len(words)), licenses.STRIDE):
        block = set(words[b : b + 2 * licenses.STRIDE])
        for label, found in licenses.template_sets():
            share = len(block & set(found)) / len(found)
            if share >= 0.8 - 1e-12:
                more.add(label)
                part = max(part, share)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else part


def test_licenses_by_hand(spark, sf, docs):
    for r in queries.op7_license_scan(spark, sf).collect():
        assert tuple(r)[1:] == pytest.approx(licenses_by_hand(docs[r.doc_id].text))


def test_licenses_odd(spark, odd_extra, no_docs):
    rows = spark.createDataFrame(
        [(1, "x " * 95 + licenses.TEMPLATES["bsd"][0].upper()), (1, "CC-BY cc by, CC  BY"), (2, None), (None, "Permission is granted, free of charge, to any person obtaining copy of this software and associated documentation")], "doc_id long, text string"
    )
    for r in [*licenses.scan(rows).collect(), *licenses.scan(odd_extra.select("doc_id", "text", "key", "words")).collect()]:
        assert r.doc_id is None or r.doc_id > 0
    got = sorted(((r.doc_id or 0, r.n_base, r.labels) for r in licenses.scan(rows).collect()))
    assert got == [(0, 0, "mit"), (1, 0, "bsd"), (1, 3, "cc-by"), (2, 0, "")]
    assert licenses.scan(no_docs).count() == 0


def test_license_blocks_by_hand(spark, sf, docs):
    """Every block of every document against every template."""
    got = {(r.doc_id, r.block, r.template): (r.first_word, r.last_word, r.label, round(r.containment, 9)) for r in licenses.matches(table(spark, sf, "documents")).collect()}
    expected = {}
    for k, r in docs.items():
        words = licenses.words_in(r.text or "")
        for b in range(0, len(words), licenses.STRIDE):
            block = set(words[b : b + 2 * licenses.STRIDE])
            for number, (label, found) in enumerate(licenses.template_sets()):
                if len(block & set(found)) / len(found) >= 0.8 - 1e-12:
                    expected[k, b // licenses.STRIDE, number] = b, min(b + 2 * licenses.STRIDE, len(words)), label, round(len(block & set(found)) / len(found), 9)
    assert got == expected and expected


# --- near duplicates ---


@pytest.mark.parametrize("size", [5, 10, 25, 60, 150, 300, 301, 375, 1000])
def test_bucket_recall_by_size(size):
    """Pairs of a similarity of just 0.8 share a bucket, whatever the size of their sets."""
    import numpy as np

    draw, sign, met = np.random.default_rng(size), neardup.Signature(30, 5), 0
    for _ in range(200):
        s = draw.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
        common = -(-size * 4 // 5)
        cut = draw.integers(common, size + 1)
        a, b = np.sort(s[:cut]), np.sort(np.concatenate([s[:common], s[cut:]]))
        met += bool((sign.keys(a) == sign.keys(b)).any())
    assert met >= 199


def test_ids_that_are_missing_or_repeated(spark):
    """Thousands of rows with null or one id: groups are those of the texts, and one row of each survives."""
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(1500)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts) for _ in range(2)] + [(None, None), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3002 and sum(r.survivor for r in got) == 1502
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (7, 7)}


def groups_by_hand(texts, words, percent):
    sets = {k: set(neardup.shingles(t, words).tolist()) for k, t in texts.items()}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_chain(spark):
    """A chain of edits: neighbours are linked, ends are not; the centre of a bucket may miss both."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts, words = {}, list(base)
    for i in range(40):
        texts[i] = " ".join(words)
        at = draw.randrange(295)
        words[at : at + 4] = [f"n{draw.randrange(10**6)}" for _ in range(4)]
    for i in range(40, 60):
        texts[i] = " ".join(f"o{draw.randrange(10**6)}" for _ in range(draw.randint(1, 50)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, words=4).collect()}
    expected = groups_by_hand(texts, 4, 80)
    assert {k: r.component_id for k, r in got.items()} == expected
    assert all(r.kept == (k == expected[k]) and r.n_shingles == len(neardup.shingles(texts[k], 4)) for k, r in got.items())


def test_near_duplicates_query(spark, sf, docs):
    got = {r.doc_id: r.component_id for r in queries.op8_near_duplicates(spark, sf).collect()}
    assert got == groups_by_hand({k: r.text for k, r in docs.items()}, 4, 80)


def test_shingles_are_whole_sequences_and_sets():
    assert len(neardup.shingles("a b c", 4)) == 1 and len(neardup.shingles("A b C d e", 4)) == 2
    assert neardup.shingles("a b c d", 4).tolist() == neardup.shingles("A  B\nc d", 4).tolist()
    assert neardup.shingles("a b c", 4).tolist() != neardup.shingles("a b c a", 4).tolist()
    assert not len(neardup.shingles(" \n", 4)) and not len(neardup.shingles(None, 4))


def test_components_of_chains_rings_and_hubs(spark):
    def least(edges):
        root = {x: x for e in edges for x in e}
        while any(root[a] != root[b] for a, b in edges):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    rng = random.Random(5)
    chain, ring = [(i, i + 1) for i in range(40)], [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    hub, loose = [(200, 200 + i) for i in range(1, 60)], [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    first = [e for e in chain + ring + hub + loose if e[0] != e[1]]
    rng.shuffle(first)
    labels = neardup.written(neardup.components(spark.createDataFrame(first, "a long, b long")), "labels")
    assert {r.node: r.label for r in labels.collect()} == least(first) and labels.count() == len(least(first))
    later = [(40, 100), (250, 105), (500, 501), (39, 502), (501, 503)]  # joins components, new nodes, new nodes to old ones
    grown = neardup.grown(labels, spark.createDataFrame(later, "a long, b long")).collect()
    assert {r.node: r.label for r in grown} == least(first + later) and len(grown) == len(least(first + later))
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert neardup.grown(labels, spark.createDataFrame([], "a long, b long")).count() == labels.count()


def test_near_duplicates_odd(odd_extra, no_docs):
    rows = neardup.near_duplicates(odd_extra.select("doc_id", "text", "k", "n"), carry=("k", "n")).collect()
    assert len(rows) == odd_extra.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].component_id == by[1].component_id == 1 and by[4].component_id == 4 and by[5].kept and by[6].n_shingles == 0
    assert neardup.near_duplicates(no_docs.select("doc_id", "text")).count() == 0


# --- shards ---


def test_hilbert_index_is_a_curve(spark):
    """Neighbours on the curve are neighbours in space, and each cell has its own place."""
    n = 1 << 3
    cells = spark.range(n**3).selectExpr("id div 64 as a", "id div 8 % 8 as b", "id % 8 as c")
    path = [(r.a, r.b, r.c) for r in sharding.with_hilbert(cells, ["a", "b", "c"], 3, "h").orderBy("h").collect()]
    assert len(set(path)) == n**3
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_are_even_and_gapless(spark, sf, docs):
    rows = queries.op9_hilbert_shards(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        text = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards_odd(odd_extra, no_docs):
    rows = sharding.hilbert_shards(odd_extra, 5).collect()
    assert len(rows) == odd_extra.count() and {r.shard for r in rows} == set(range(5))
    assert {r.size for r in rows if r.doc_id == 4} == {1}
    assert sharding.hilbert_shards(no_docs, 5).count() == 0


def test_shard_files_prune(spark, sf, tmp_path):
    """All rows are in the files of their shard, in curve order; filters on each dimension skip shards and lose nothing."""
    docs = table(spark, sf, "documents")
    manifest = sharding.write_shards(docs, f"file://{tmp_path}/out", 16).cache()
    data = spark.read.parquet(f"file://{tmp_path}/out/data").withColumnRenamed(P + "shard", "shard")
    assert sorted(map(tuple, data.drop("shard").select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    shard_of = {r.doc_id: r.shard for r in queries.op9_hilbert_shards(spark, sf).collect()}
    rows = data.collect()
    assert all(shard_of[r.doc_id] == r.shard for r in rows) and sum(r.rows for r in manifest.collect()) == len(rows)
    skipped = {}
    for column, least, most in (("lang", "fr", "fr"), ("size", 1, 60), ("source", "src1", "src1")):
        named = sharding.pruned(manifest, column, least, most)
        value = lambda r: len((r.text or "").encode()) + 1 if column == "size" else r[column]
        assert {r.shard for r in rows if value(r) is not None and least <= value(r) <= most} <= set(named)
        skipped[column] = 16 - len(named)
    assert skipped["lang"] > 0 and skipped["size"] > 0
    manifest.unpersist()


# --- decontamination ---


def test_leaks_query_by_brute_force(spark, sf, docs):
    """Each document against each item: least edits and the first place with so many; nothing else is reported."""
    items = {r.item_id: decontaminate.words_of(r.text) for r in table(spark, sf, "benchmark").collect()}
    expected = {}
    for k, r in docs.items():
        words = decontaminate.words_of(r.text)
        for i, own in items.items():
            edits, place = decontaminate.edits_at_best_place(own, words)
            if own and edits <= int(0.2 * len(own)):
                expected[k, i] = place, len(own), edits, 1 - edits / len(own)
    got = {(r.doc_id, r.item_id): (r.start_word, r.item_words, r.edits, r.similarity) for r in queries.op10_decontaminate(spark, sf).collect()}
    assert set(got) <= set(expected) and len(got) >= 0.95 * len(expected)
    assert {k for k, x in expected.items() if x[2] == 0} <= set(got)
    assert sum(got[k] == expected[k] for k in got) >= 0.95 * len(got)


def test_leaks_of_short_equal_and_unparted_items(spark):
    items = [(1, "Paris"), (2, "paris"), (3, "two words"), (4, "東京は日本の首都です"), (5, "a b c d e f g h i j " * 300)]
    docs = [(1, "he went to Paris, then home"), (2, "only two, words here"), (3, "彼は東京は日本の首都ですと言った"), (4, "parisian words two"), (5, "x " + "a b c d e f g h i j " * 300)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(1, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (5, 5, 0)]


def plain_edits(item, window):
    """Least edits and least begin by the whole matrix."""
    row = [(0, j) for j in range(len(window) + 1)]
    for i, word in enumerate(item, 1):
        new = [(i, 0)]
        for j, other in enumerate(window, 1):
            new.append(min((row[j - 1][0] + (word != other), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return min(row)


def test_edits_equal_the_whole_matrix():
    draw = random.Random(3)
    for _ in range(1500):
        item = [bytes([draw.randrange(97, 100)]) for _ in range(draw.randint(1, 9))]
        window = [bytes([draw.randrange(97, 100)]) for _ in range(draw.randint(0, 12))]
        edits, begin = plain_edits(item, window)
        assert decontaminate.edits_at_best_place(item, window)[0] == edits
        if edits < len(item):
            assert decontaminate.edits_at_best_place(item, window)[1] == begin


def test_leaks_exact_copies(spark, sf, docs):
    items = {r.item_id: decontaminate.words_of(r.text) for r in table(spark, sf, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).where("edits = 0").collect()}
    inside = lambda a, b: b" " + b" ".join(a) + b" " in b" " + b" ".join(b) + b" "
    assert got == {(k, i) for k, r in docs.items() for i, w in items.items() if inside(w, decontaminate.words_of(r.text))}


def test_leaks_edited_recall(spark, sf, docs):
    """Passages with one word in twenty edited, hidden in documents: the target recall, and none in clean ones."""
    draw = random.Random(6)
    pool = [w.decode() for r in docs.values() for w in decontaminate.words_of(r.text)]
    items = [(i, " ".join(draw.choices(pool, k=draw.randint(15, 60)))) for i in range(150)]
    rows = []
    for i, text in items:
        words = text.split()
        for _ in range(max(1, len(words) // 20)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 1)] = [draw.choice(pool)] * draw.randint(0, 1)
        rows.append((i, " ".join([*draw.choices(pool, k=40), *words, *draw.choices(pool, k=40)])))
        rows.append((1000 + i, " ".join(draw.choices(pool, k=100))))
    leaks = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in leaks}
    assert len([i for i, _ in items if (i, i) in found]) >= 0.95 * len(items)
    assert not any(d >= 1000 for d, _ in found)


def hidden(draw, pool, words):
    return " ".join([*draw.choices(pool, k=40), *words, *draw.choices(pool, k=40)])


@pytest.mark.parametrize("edit", ["substituted", "deleted"])
def test_leaks_first_word_edited(edit):
    """Items of 5 to 31 words whose first word is another one or missing: every one is found."""
    draw = random.Random(8)
    pool = [f"w{i}" for i in range(5000)]
    items = [draw.choices(pool, k=5 + i % 27) for i in range(270)]
    block = decontaminate.Items(list(range(270)), [decontaminate.words_of(" ".join(w)) for w in items], 6, 0.2)
    texts = [hidden(draw, pool, [*(["other"] if edit == "substituted" else []), *w[1:]]) for w in items]
    found = {(n, i): edits for n, i, _, edits in block.leaks(texts)}
    assert [i for i in range(270) if found.get((i, i)) != 1] == []


@pytest.mark.parametrize("least, most, floor", [(5, 7, 1), (8, 15, 1), (16, 20, 1), (21, 31, 1), (32, 36, 0.95), (37, 63, 0.95), (64, 128, 0.95), (200, 300, 0.95)])
def test_leaks_recall_at_share(spark, least, most, floor):
    """The shipped search finds the target share of passages with as many edits as are allowed, at every length."""
    draw = random.Random(least)
    pool = [f"w{i}" for i in range(20000)]
    items = [draw.choices(pool, k=draw.randint(least, most)) for _ in range(200)]
    docs = []
    for i, own in enumerate(items):
        words = list(own)
        for at in sorted(draw.sample(range(len(own)), int(0.2 * len(own))), reverse=True):
            kind = draw.randrange(3)
            words[at : at + (kind < 2)] = [draw.choice(pool)] * (kind > 0)
        docs.append((i, hidden(draw, pool, words)))
    rows = [(i, " ".join(w)) for i, w in enumerate(items)]
    leaks = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert sum(r.doc_id == r.item_id for r in leaks) >= floor * len(items)


def test_leaks_odd(spark, odd_extra, no_docs):
    from .conftest import PROSE

    items = spark.createDataFrame([(1, PROSE[0]), (2, None), (3, ""), (None, PROSE[2].upper()), (4, "not there")], "item_id long, text string")
    kept = decontaminate.without_leaks(odd_extra, items)
    assert kept.columns == odd_extra.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 9, 10]
    assert sorted(((r.doc_id or 0), r.item_id or 0) for r in decontaminate.find_leaks(odd_extra, items).collect()) == [(0, 1), (1, 1), (3, 0), (7, 1), (7, 1)]
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.without_leaks(odd_extra, items.where("false")).count() == odd_extra.count()


def test_edit_distance():
    f = decontaminate.edits_at_best_place
    assert f([b"a", b"b", b"c"], [b"x", b"a", b"b", b"c"]) == (0, 1)
    assert f([b"a", b"b", b"c"], [b"x", b"a", b"c", b"y"])[0] == 1
    assert f([b"a"], [])[0] == 1


def test_whole_licenses_are_found(spark):
    """A template of any length: blocks grow with the longest one."""
    rng = random.Random(8)
    words = [f"term{i}" for i in range(400)]
    whole = [rng.choice(words) for _ in range(700)]
    templates = {"long": [" ".join(whole)], **licenses.TEMPLATES}
    noise = lambda n: [f"noise{rng.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(noise(a) + whole + noise(b)) for a, b in ((0, 0), (350, 10), (699, 700), (1234, 5))]
    texts += [" ".join(noise(900) + whole[:200] + noise(900)), " ".join(noise(30)) + " released under the mit license", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df, templates=templates).collect()}
    assert [got[i] for i in range(8)] == ["long"] * 4 + ["", "mit", "", ""]
    assert {r.doc_id for r in licenses.matches(df, templates=templates).where("label = 'long'").collect()} == {0, 1, 2, 3}


def test_leaks_of_several_blocks(spark, monkeypatch):
    """Items in blocks that are made, searched and let go one after the other find what one block finds."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(20)) for _ in range(9)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([word(), texts[i % 9], word()]) if i % 2 else word()) for i in range(30)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    clean = sorted(map(tuple, decontaminate.without_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert len(one) == 15 and sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == one
    assert len(clean) == 15 and sorted(map(tuple, decontaminate.without_leaks(docs, items).collect())) == clean
