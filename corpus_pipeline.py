"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

quality rules -> line dedup -> MinHash near-dedup -> benchmark decontamination -> byte-level BPE.
Every stage works on all rows that the one before it kept and returns the columns of
documents; the last one returns doc_id and what its ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.llm import bpe, decontaminate, linededup, neardup, quality
from lodestep.llm.common import P, cols, table, written
from lodestep.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judged(docs).where(F.col(P + "kept")).select(*cols(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text."""
    out = linededup.without_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8.

    Rows that repeat each other are one group and one of them stays, also where ids are null or
    repeated; rows without a word are linked with nothing and all stay.
    """
    named = docs.select(*cols(docs), linededup.row_key(docs).alias(P + "key"))
    found = written(neardup.near_duplicates(named, carry=(P + "key",), words=5, percent=80).select(P + "key", "survivor"), "survivors")
    gone = found.where("not survivor").select(P + "key").distinct()
    left = named.join(gone, P + "key", "left_anti")
    # a row that repeats the survivor has its key too: of such rows one stays
    repeated = written(gone.join(found.where("survivor").select(P + "key"), P + "key", "left_semi"), "repeated")
    if not repeated.isEmpty():
        left = left.unionByName(named.join(repeated, P + "key", "left_semi").dropDuplicates([P + "key"]))
    return left.select(*cols(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, hashes of the ids and of the bytes that they decode to."""
    return bpe.encode_digests(docs.select("doc_id", "text"), *vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the similarity groups nor the edit search nor the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
