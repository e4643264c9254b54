"""Byte-exact string functions: offsets here are bytes of UTF-8, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(s: Column) -> Column:
    return s.cast("binary")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def byte_at(b: Column, i: Column) -> Column:
    """The byte at 0-based i as an integer; null past the end."""
    return F.conv(F.nullif(F.hex(F.substr(b, (i + 1).cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int")


def is_continuation(b: Column, i: Column) -> Column:
    return F.coalesce(byte_at(b, i).bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))


def slice_bytes(s: Column, start: Column, end: Column) -> Column:
    """s[start..end] by bytes; both must be character boundaries."""
    return F.decode(F.substr(utf8(s), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def clip_head(s: Column, n: int) -> Column:
    """The longest beginning of at most n bytes that ends at a character boundary."""
    b = utf8(s)
    cut = F.lit(n - 3)
    for back in range(3, -1, -1):
        if n - back >= 0:
            cut = F.when(~is_continuation(b, F.lit(n - back)), F.lit(n - back)).otherwise(cut)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.decode(F.substr(b, F.lit(1), cut), "UTF-8"))


def clip_tail(s: Column, n: int) -> Column:
    """The longest end of at most n bytes that begins at a character boundary."""
    b, size = utf8(s), F.octet_length(s)
    start = size - n + 3
    for ahead in range(3, -1, -1):
        start = F.when(~is_continuation(b, size - n + ahead), size - n + ahead).otherwise(start)
    return F.when(size <= n, s).otherwise(F.decode(F.substr(b, start + 1, F.lit(n)), "UTF-8"))
