"""Deterministic hashes for splits, folds, arms and orders; equal in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digest(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


def head(x: Column, digits: int) -> Column:
    """The digest's first hexadecimal digits as a whole number (16 digits: up to 2^64 - 1)."""
    return F.conv(F.substring(hex_digest(x), 1, digits), 16, 10).cast("decimal(20,0)")


def unit(x: Column) -> Column:
    """[0, 1): the first eight bytes, big-endian, over 2^64."""
    return head(x, 16).cast("double") / F.lit(2.0**64)


def fold(x: Column, k: int, digits: int = 16) -> Column:
    """hash mod k, by the first eight bytes (16 digits) or four (8 digits): two different conventions."""
    return (head(x, digits) % k).cast("long")


def arm(x: Column, prefix: str, of_256: int = 128) -> Column:
    """treatment where the first byte is below of_256."""
    return F.when(head(F.concat(F.lit(prefix), x.cast("string")), 2) < of_256, "treatment").otherwise("control")


def interval(x: Column, bounds: list[tuple[int, str]], of: int = 10_000) -> Column:
    """The label of the first bound that hash mod `of` is below; excluded beyond all."""
    h = head(x, 16) % of
    out = F.lit("excluded")
    for most, label in reversed(bounds):
        out = F.when(h < most, label).otherwise(out)
    return out
