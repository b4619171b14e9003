"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lexical, licenses, linededup, manifest, neardup, oracle, packing, quality, repeats, sharding, warc
from .common import P, ascii_lower, table


def vocabulary() -> tuple[str, str]:
    """Path of the byte-level ranks and the split pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.captures_of_pages(table(spark, sf_dir, "pages"))
    out = warc.resolve_revisits(records)
    entries = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return out.select("record_id", "url_key", F.unix_seconds("captured_at").alias("captured_at"), "status", "source_id", entries.alias("headers"), F.octet_length("body").cast("bigint").alias("body_bytes"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, *vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    languages = langid.learn(docs.where(~out))
    return langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), languages).select("doc_id", "held_out", "lang_pred", "score", "confident")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.without_common_lines(docs, min_docs=10, min_chars=1)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col(P + "n_lines").alias("n_lines"), F.col(P + "n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), length=2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(docs, keep=["doc_id"]).select("doc_id", *(F.col(P + c).alias(c) for c in columns))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = sharding.hilbert_shards(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row, by its id's checksum, is tampered with: its text's A-Z are lowered. The proofs tell which rows."""
    docs = table(spark, sf_dir, "documents")
    itself = manifest.tampered(docs, F.col("text"))
    wrong = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.tampered(docs, ascii_lower(F.col("text")))).otherwise(itself)
    out = manifest.manifest(docs, carry={"given": wrong})
    hexed = lambda c: F.lower(F.hex(c))
    made = out.withColumn("folded", manifest.folded(F.col("given"), F.col("steps")))
    return made.select("doc_id", *(hexed(c).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(manifest.proof_text(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=400)
    return out.select("doc_id", *(F.col(P + c).alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_pack_tokens, op4_quality_rules, op5_warc_revisits, op6_byte_bpe, op7_license_scan, op8_near_duplicates, op9_hilbert_shards, op10_decontaminate, op11_ranked_search, op12_merkle_manifest, op13_repeated_strings)}
ORACLE_SQL = oracle.ORACLE_SQL
