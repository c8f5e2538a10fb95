"""Portable string and sequence hashes: polynomials of base 31 modulo 2**32, on code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2**32


def text_hash(text: Column) -> Column:
    """Unsigned 32-bit polynomial hash of a string; null for null."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % MODULUS)


def sequence_hash(unit_hashes: Column) -> Column:
    """Unsigned 32-bit hash of a list of hashed units, starting from 1."""
    return F.aggregate(unit_hashes, F.lit(1).cast("long"), lambda a, h: (a * 31 + h) % MODULUS)


def content_hash(content: Column) -> Column:
    """Upper-case hexadecimal SHA-256."""
    return F.upper(F.sha2(content.cast("binary"), 256))
