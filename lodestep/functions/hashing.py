"""Hashing and counter-based draws as JVM-side columns, equal to ``kernel`` bit for bit.

64-bit words are BIGINTs with the same bits. Their products wrap, so the columns
must be bound while ANSI arithmetic is off; ``wrapping`` does that around the
``select`` and leaves the session's setting as it was.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import kernel as K


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@contextmanager
def wrapping(spark: SparkSession):
    """Expressions that are bound in this block keep wrapping arithmetic, whatever the session's ANSI mode."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _bytes(c: Column) -> Column:
    """The bytes of a binary column: read as Latin-1, each byte is the character of its number."""
    return F.split(F.decode(c, "ISO-8859-1"), "")


def fnv1a_64(c: Column, start: Column | None = None) -> Column:
    """Fold of a binary column; ``start`` goes on from an earlier fold."""
    start = F.lit(signed(K.FNV_OFFSET)) if start is None else start
    folded = F.aggregate(_bytes(c), start, lambda h, b: h.bitwiseXOR(F.ascii(b).cast("bigint")) * F.lit(K.FNV_PRIME))
    return F.when(F.octet_length(c) == 0, start).otherwise(folded)


def mix64(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * F.lit(signed(K.MIX_1))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * F.lit(signed(K.MIX_2))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def derive_key(decision_id: Column, salt: Column) -> Column:
    """Key of a decision's draws. The id's length goes before it, as 8 bytes from the lowest."""
    own = decision_id.cast("binary")
    start, length = F.lit(signed(K.FNV_OFFSET)), F.octet_length(own).cast("bigint")
    for i in range(8):
        start = start.bitwiseXOR(F.shiftrightunsigned(length, 8 * i).bitwiseAND(F.lit(255))) * F.lit(K.FNV_PRIME)
    return fnv1a_64(F.concat(own, salt.cast("binary")), start)


def random_u64(key: Column, counter: Column | int) -> Column:
    counter = F.lit(counter) if isinstance(counter, int) else counter
    return mix64(key + counter.cast("bigint") * F.lit(signed(K.GOLDEN)))


def random_unit(key: Column, counter: Column | int) -> Column:
    return F.shiftrightunsigned(random_u64(key, counter), 11).cast("double") * F.lit(2.0**-53)


def begun(left: Column) -> Column:
    """The fold of a left token and the separator, from which all its pairs go on."""
    return fnv1a_64(F.concat(left.cast("binary"), F.lit(K.SEPARATOR)))


def pair_hash(left: Column, right: Column) -> Column:
    return pair_hash_from(begun(left), right)


def pair_hash_from(start: Column, right: Column) -> Column:
    return mix64(fnv1a_64(right.cast("binary"), start))


def hex64(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")
