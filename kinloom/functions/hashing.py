"""Portable folds: the same in Spark and in SQL, whatever the engine's own hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(col: Column, seed: int, n: int) -> Column:
    """0 .. n - 1 by the first 32 bits of md5(value:seed)."""
    head = F.substring(F.md5(F.concat(col, F.lit(f":{seed}"))), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % n).cast("bigint")


def fold_sql(col: str, seed: int, n: int) -> str:
    return f"(cast(('0x' || substr(md5({col} || ':{seed}'), 1, 8)) as bigint) % {n})"
