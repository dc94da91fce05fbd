"""Salted identifiers and reproducible draws, both from digests any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_key(column: Column, data_type: T.DataType) -> Column:
    """The text that gets hashed: an integral number reads the same whatever its type."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = F.floor(column)
        integral = (column == whole) & (F.abs(column) < F.lit(9.0e18))
        return F.when(integral, whole.cast("string")).otherwise(column.cast("string"))
    if isinstance(data_type, T.DecimalType):
        whole = F.floor(column)
        return F.when(column == whole, whole.cast("string")).otherwise(column.cast("string"))
    if isinstance(data_type, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def salted_hash(column: Column, salt: str, data_type: T.DataType | None = None) -> Column:
    """SHA-256 over ``salt:key`` in hex, whole; null stays null, a blank salt is refused."""
    if not salt or not salt.strip():
        raise ValueError("an empty salt would leave public ids open to a dictionary attack")
    key = canonical_key(column, data_type or T.StringType())
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), key), 256)
    return F.when(column.isNotNull(), digest)


def draw_digits(*parts: Column) -> Column:
    """The 15 hexadecimal digits of :func:`draw_number`; they order like the number."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.substring(F.md5(text), 1, 15)


def digits_number(digits: Column) -> Column:
    """The number that hexadecimal digits stand for."""
    return F.conv(digits, 16, 10).cast("long")


def draw_number(*parts: Column) -> Column:
    """A 60-bit integer from the MD5 of the joined parts: uniform, and equal on every engine."""
    return digits_number(draw_digits(*parts))


def draw_index(size: Column, *parts: Column) -> Column:
    """A draw in ``[0, size)``."""
    return F.pmod(draw_number(*parts), size)
