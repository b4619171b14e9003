"""Language identification by compression.

For each learned language a raw-content zstandard dictionary holds text of that
language. A text, in lower case, is compressed, block by block, with every dictionary; the
language whose dictionary leaves the fewest bytes is the prediction. The margin
is what the runner-up needs more, as a share of its bytes; where it is under
``min_margin`` the prediction is rejected (``confident`` is false).

Learning takes a bounded sample: of each language the ``SAMPLE_ROWS`` distinct labelled
texts with the least hash, up to ``SAMPLE_CHARS`` of each (many short
samples beat a few long ones), fill its dictionary of ``DICT_BYTES``.
Which rows may be learned from is the caller's choice. Prediction reads whole
texts, and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Rows with a null language are not learned from. Where nothing can be learned
every text is ``und``. Equal sizes go to the language that sorts first. More than
``MAX_LANGUAGES`` languages are an error: their dictionaries go to every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, quoted, refuse_taken

#: The bound of the sample: rows of a language, and the length of the block that each gives, from anywhere in its text.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 1500
BLOCK_CHARS, LEVEL = 4096, 6
MAX_LANGUAGES = 400
UND = "und"


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language.

    Two passes: about how many distinct texts each language has (a sketch a
    language), then those whose hash lies in the least share that holds about twice
    SAMPLE_ROWS of them; copies count once, however many. At most SAMPLE_ROWS blocks a
    language reach the driver. A text's block begins at a place that its hash chooses.
    """
    own = labelled.select(F.col(quoted(lang)).alias("lang"), F.xxhash64(quoted(text)).alias("x"), F.col(quoted(text)).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("x", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    drawn = own.withColumn("h", F.pmod("x", F.lit(1 << 40)) / float(1 << 40))
    share = F.create_map(*(x for name, n in sorted(counts.items()) for x in (F.lit(name), F.lit(1.0 if n <= 2 * SAMPLE_ROWS else 2 * SAMPLE_ROWS / n))))
    begin = F.pmod(F.xxhash64(F.lit(5), "text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    near = drawn.where(F.col("h") <= share[F.col("lang")]).select("lang", "h", F.lower(F.col("text").substr(begin.cast("int"), F.lit(SAMPLE_CHARS))).alias("text"))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    by_lang = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, SAMPLE_ROWS).alias("rows")).collect()
    return {r["lang"]: b"\n".join(t.encode() for _, t in r["rows"]) for r in by_lang}


_prepared: dict[int, list] = {}


def _compressors(languages: dict[str, bytes]) -> list:
    import zstandard

    key = hash(tuple(sorted(languages.items())))
    if key not in _prepared:
        made = []
        for name, content in sorted(languages.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
        _prepared[key] = made
    return _prepared[key]


def classify(text: str | None, compressors: list) -> tuple[str, float]:
    """Language and margin (0 to 1) of a whole text."""
    if not text or not compressors or not any(map(str.isalpha, text)):
        return UND, 0.0
    text = text.lower()
    blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
    sizes = sorted((sum(len(compress(b)) for b in blocks), name) for name, compress in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, languages: dict[str, bytes], *, text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: the margin, stretched) and confident; these names must be free."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # the sample's bound a language
    refuse_taken(docs, "lang_pred", "score", "confident")
    at = docs.columns.index(text)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confident", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in it:
            found = [classify(t.as_py(), _compressors(shared.value)) for t in batch.column(at)]
            made = [[n for n, _ in found], [m / (m + 0.05) if m > 0 else 0.0 for _, m in found], [n != UND and m >= min_margin for n, m in found]]
            given = [batch.column(i).cast(out.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(v, out.field(batch.num_columns + i).type) for i, v in enumerate(made))], schema=out)

    return by_place(docs).mapInArrow(batches, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
