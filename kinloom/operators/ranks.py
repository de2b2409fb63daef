"""Ranks inside groups of which a few hold most rows, and row numbers of whole tables, without a task that holds a group.

A hot group is sorted over several range partitions; a row's rank is its place in its own range plus the rows of the
group in the ranges before, which are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import materialize


def _placed(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, 1 .. n in ``order`` inside the values of ``key`` (of the table, if there is none)."""
    # the ranges are drawn from a sample, so they are written down once
    spread = materialize(df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = spread.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as ranges
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    return spread.withColumn("_own", own).join(offsets, [*key, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_own", "_before", "_range")


def ranked(df: DataFrame, key: str, order: list[Column], name: str, most: int = 500_000) -> DataFrame:
    """Adds ``name``, the ordinal rank of each row in ``order`` inside its ``key``; groups of more than ``most`` rows over several tasks."""
    hot = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key), "hot")
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, plain)
    cold = df.join(hot, key, "left_anti").withColumn(name, plain)
    return cold.unionByName(_placed(df.join(F.broadcast(hot), key, "left_semi"), [key], order, name))  # rows / most of them at most


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``row``, 0 .. n - 1 in the order of ``keys``."""
    return _placed(df, [], [F.col(k) for k in keys], "row").withColumn("row", F.col("row") - 1)
