"""Quality rules with adaptive thresholds. DataFrame functions only.

Fixed cutoffs are replaced by fences that each language and source sets for
itself. All measures are ratios that ordinary prose has, so they are compared on a logarithmic scale: a
document is rejected where a measure lies ``spread`` times as far beyond the upper quartile of its own
group as that lies beyond the median, that is, where it stands out from its own kind. No measure has a
constant of its own. The quantiles come from mergeable
sketches: counts in logarithmic buckets with a bounded relative error (DDSketch).
Adding counts merges them exactly, in any order, so the sketch of a language is
the sum of those of its sources, and results don't depend on the partitioning.

A measure that is 0 in a document never rejects it, and the quartiles are those of the documents that have
the measure: scripts without capitals set no fence for them. Where median and upper quartile share a bucket, a
bucket's width counts as their distance. A small group's quartiles are drawn towards those of its language, and these towards
those of all documents: a group of n documents counts n^2 / (n^2 + prior^2). The fences, a row for each language and source, are
joined to the measured documents.

Defined results: null texts have no words and fail the base rules. Null languages
and sources are groups of their own. Every row is judged by itself, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, cols, quoted, written

#: Relative width of a sketch bucket: quantiles are exact to about 1 %.
GAMMA = 1.02
#: Measures that the fences hold for: name and expression over the counts.
MEASURES = {
    "word_length": f"{P}word_chars / {P}n_words",
    "capitals": f"{P}n_capitals / {P}word_chars",
    "marks": f"{P}n_marks / {P}word_chars",
    "line_words": f"{P}n_words / {P}n_lines",
}
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines", "base_failed")
_SPACE = r"[\x20\x09-\x0D]"
MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def _repeat_words() -> Column:
    """Words in 5-word windows that occur twice or more in the text, from the array ``words``.

    The windows' 64-bit hashes are compared within the text only. Where none
    repeats (most texts) the distinct count shows it; else the hashes are sorted
    with their places, and the covered words of the repeated ones counted.
    """
    words, h = F.col(P + "words"), F.col(P + "windows")
    places = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(words) < 5, F.lit(0)).when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(F.sort_array(places)))


def _covered(ordered: Column) -> Column:
    """Number of words in the windows whose hash has an equal neighbour in the sorted (h, i)."""
    n = F.size(ordered)
    nothing = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i")))
    before = F.concat(nothing, F.slice(ordered, 1, F.greatest(n - 1, F.lit(1))))
    after = F.concat(F.slice(ordered, 2, F.greatest(n - 1, F.lit(1))), nothing)
    near = F.arrays_zip(before.alias("b"), ordered.alias("x"), after.alias("a"))
    repeated = F.filter(near, lambda z: (z["x"]["h"] == z["b"]["h"]) | (z["x"]["h"] == z["a"]["h"]))
    at = F.sort_array(F.transform(repeated, lambda z: z["x"]["i"]))
    total = F.aggregate(at, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(5))).alias("n")))
    return total["n"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text, as columns of the prefix: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals (A-Z), n_marks (ASCII punctuation and symbols), n_lines (with a word), base_failed."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    given = docs.columns
    split = docs.select(*cols(docs), F.filter(F.split(t, _SPACE + "+"), lambda w: w != "").alias(P + "words"))
    words = F.col(P + "words")
    starts = F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, 5))))
    with_windows = split.select(*(F.col(quoted(c)) for c in split.columns), windows.alias(P + "windows"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = with_windows.select(
        *(F.col(quoted(c)) for c in given),
        F.size(words).cast("bigint").alias(P + "n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias(P + "word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias(P + "n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("bigint").alias(P + "n_capitals"),
        (F.length(t) - F.length(F.regexp_replace(t, MARKS, ""))).cast("bigint").alias(P + "n_marks"),
        F.size(lines).cast("bigint").alias(P + "n_lines"),
        F.when(F.instr(t, "\n") > 0, F.aggregate(F.array(lines), F.lit(0), lambda a, x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("bigint").alias(P + "n_dup_lines"),
        _repeat_words().cast("bigint").alias(P + "n_repeat_words"),
    )
    failed = F.expr(f"{P}n_words < {MIN_WORDS} or 100 * {P}n_repeat_words > {MAX_REPEAT_PERCENT} * {P}n_words")
    return counted.withColumn(P + "base_failed", failed)


def _bucket(value: Column) -> Column:
    """Sketch bucket of a value; null for 0."""
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(GAMMA)))).cast("int")


def sketches(docs: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, bucket, n): the sketch of each group and measure over documents that pass the base rules and have the measure."""
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), _bucket(F.expr(e)).alias("bucket")) for name, e in MEASURES.items())))
    rows = docs.where(~F.col(P + "base_failed")).select(*group, values.alias("v")).where("v.bucket is not null")
    return rows.groupBy(*group, F.col("v.measure").alias("measure"), F.col("v.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, total, b2, b3): the buckets of median and upper quartile, from the cumulated counts of a sketch."""
    from pyspark.sql import Window

    by = [*group, "measure"]
    total = F.sum("n").over(Window.partitionBy(*by))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    ranked = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n")).select(*by, "bucket", total.alias("total"), below.alias("below"))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bucket"))).cast("double")
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), at(0.5).alias("b2"), at(0.75).alias("b3"))


def thresholds(sketch: DataFrame, *, spread: float = 8.0, prior: int = 100) -> DataFrame:
    """(lang, source, one column a measure): each group's fences, from its quartiles drawn towards those of larger groups."""
    lang, source = P + "lang", P + "source"
    own, of_lang, of_all = (_quartiles(sketch, g).alias(x) for g, x in (([lang, source], "g"), ([lang], "l"), ([], "a")))
    joined = own.join(of_lang, F.col(f"g.{lang}").eqNullSafe(F.col(f"l.{lang}")) & (F.col("g.measure") == F.col("l.measure"))).join(of_all, F.col("g.measure") == F.col("a.measure"))
    weight = lambda x: F.col(f"{x}.total").cast("double") * F.col(f"{x}.total")
    drawn = lambda x, q, to: (weight(x) * F.col(f"{x}.{q}") + F.lit(float(prior**2)) * to) / (weight(x) + F.lit(float(prior**2)))
    b2, b3 = (drawn("g", q, drawn("l", q, F.col(f"a.{q}"))) for q in ("b2", "b3"))
    per = joined.select(F.col(f"g.{lang}").alias(lang), F.col(f"g.{source}").alias(source), F.col("g.measure").alias("measure"), b2.alias("b2"), b3.alias("b3"))
    fence = F.pow(F.lit(GAMMA), F.col("b3") + F.lit(spread) * F.greatest(F.col("b3") - F.col("b2"), F.lit(1.0)))
    return per.groupBy(lang, source).agg(*(F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES))


def judged(docs: DataFrame, *, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source", spread: float = 8.0, prior: int = 100) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), the counts and ``kept``; new columns are under the prefix.

    The measured rows are written once: sketching and filtering both read them.
    A text is written with them only if it is among the kept columns.
    """
    keep = docs.columns if keep is None else keep
    counts = [P + c for c in COUNTS]
    group = [P + "lang", P + "source"]
    named = measured(docs, text).withColumns({group[0]: F.col(quoted(lang)), group[1]: F.col(quoted(source))})
    rows = written(named.select(*(F.col(quoted(c)) for c in keep), *counts, *group), "measured")
    fences = written(thresholds(sketches(rows, group), spread=spread, prior=prior), "fences")
    limits = fences.select(*(F.col(c).alias(f"{P}f_{c}") for c in fences.columns))
    same = rows[group[0]].eqNullSafe(limits[f"{P}f_{group[0]}"]) & rows[group[1]].eqNullSafe(limits[f"{P}f_{group[1]}"])
    within = F.lit(True)
    for name, e in MEASURES.items():
        within = within & F.expr(f"coalesce({e} <= {P}f_{name}, true)")
    return rows.join(limits, same, "left").select(*(F.col(quoted(c)) for c in keep), *counts, (~F.col(P + "base_failed") & within).alias(P + "kept"))
