"""Tests of content: binary, encoding, private keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
CONTROL = r"[\x00-\x08\x0B\x0E-\x1F\x7F]"
PRIVATE_KEY = r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z0-9]++ )*+PRIVATE KEY-----"  # possessive: stepped through without recursion


def is_binary(text: Column) -> Column:
    return text.rlike(CONTROL)


def has_private_key(text: Column) -> Column:
    return text.rlike(PRIVATE_KEY)


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def read_status(text: Column, valid: Column, size: Column, most: int) -> Column:
    """The outcome of reading a file, in the order of the tests."""
    return F.when(size > most, "size_limit").when(is_binary(text), "binary").when(~valid, "encoding").when(has_private_key(text), "private_key").otherwise("ok")
