"""What the training-data operators share: column names, row keys and text expressions, and the library's written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import forget, new_path, shared_dir, written

__all__ = ["P", "ascii_lower", "by_place", "cols", "forget", "hash128", "new_path", "quoted", "refuse_taken", "shared_dir", "table", "written"]

#: Names that operators add to a caller's rows start so, so that they can't clash with the caller's columns.
P = "__lds_"


def quoted(name: str) -> str:
    """A column name as an expression takes it, with dots and ticks in it kept."""
    return "`" + name.replace("`", "``") + "`"


def cols(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Letters beyond ASCII that lower() would change; only A-Z are to be lowered.
_UPPER_BEYOND_ASCII = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def refuse_taken(docs: DataFrame | list[str], *names: str) -> None:
    """Raise if a table has one of the columns that an operator is about to add."""
    given = docs if isinstance(docs, list) else docs.columns
    if taken := [n for n in names if n.lower() in {c.lower() for c in given}]:
        raise ValueError(f"there is a column {taken[0]} already")


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place: names with dots can't go into a map over batches."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does it fast where no other capital occurs; else character by character."""
    return F.when(c.rlike(_UPPER_BEYOND_ASCII), F.translate(c, _UPPER, _LOWER)).otherwise(F.lower(c))


def hash128(*parts: Column) -> Column:
    """Two independent 64-bit hashes as 16 bytes: a key that doesn't collide at corpus size. Nulls count as values."""
    null = [F.coalesce(p, F.lit("")) for p in parts] + [p.isNull() for p in parts]
    return F.concat(*(F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), *null)), 16, "0")) for seed in (17, 71)))
