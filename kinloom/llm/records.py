"""Names and addresses of record tables, read into components once, and the expansion of class pairs into record pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.addresses import read_address
from kinloom.llm.names import read_name

NAME_PARTS = ("words", "trade", "given", "parent")
ADDRESS_PARTS = ("number", "compass", "street", "kind", "town", "state", "postcode")


def core(words: str = "words") -> Column:
    """The own words run together."""
    return F.translate(words, " ", "")


def swapped(words: str = "words") -> Column:
    """The own words with the first moved to the end, run together; '' for a single word."""
    first = F.substring_index(words, " ", 1)
    rest = F.substring(F.col(words), F.length(first) + 1, F.length(words))
    return F.when(F.contains(F.col(words), F.lit(" ")), F.translate(F.concat(rest, first), " ", "")).otherwise("")


def read_records(df: DataFrame, names: bool, addresses: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, country, ...) with the parts of the name and of the address, all strings, '' where absent.

    Needs ``entity_id``, ``country``, and ``business_name`` and/or ``business_address``; NULL countries become ''.
    ``keep`` names further string columns to carry.
    """
    source = ["business_name"] * names + ["business_address"] * addresses
    cols = [*(NAME_PARTS if names else ()), *(ADDRESS_PARTS if addresses else ())]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["id", "country", *keep, *cols]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch["id"], batch["country"], *(batch[k] for k in keep)]
            if names:
                got = [read_name(x) for x in batch["business_name"].to_pylist()]
                out += [pa.array([getattr(n, p) for n in got], pa.string()) for p in NAME_PARTS]
            if addresses:
                read_ = [read_address(x, c) for x, c in zip(batch["business_address"].to_pylist(), batch["country"].to_pylist(), strict=True)]
                out += [pa.array([getattr(x, p) for x in read_], pa.string()) for p in ADDRESS_PARTS]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    slim = df.select(F.col("entity_id").alias("id"), F.coalesce("country", F.lit("")).alias("country"), *keep, *source).filter(F.col("id").isNotNull())
    return slim.mapInArrow(read, schema)


def expand_pairs(left: DataFrame, right: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """(left_id, right_id) for rows of ``left`` (cls, left_id) and ``right`` (cls, right_id) of one class.

    A class with more than the root of ``cell`` rows on a side is cut into parts of about that many, and every part of one side meets
    every part of the other in a cell of its own, so no task gets more than about ``cell`` pairs of a class however large
    it is. Rows must be distinct on either side.
    """
    side = max(1, int(cell**0.5))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cls").agg(F.count("*").alias("n")).filter(F.col("n") > side).select("cls", F.ceil(F.col("n") / side).cast("int").alias(name))

    hot = parts(left, "gl").join(parts(right, "gr"), "cls", "full").select("cls", F.coalesce("gl", F.lit(1)).alias("gl"), F.coalesce("gr", F.lit(1)).alias("gr"))

    def gridded(df: DataFrame, own: str, id_col: str, other: str) -> DataFrame:
        df = df.join(hot, "cls", "left").withColumns({"gl": F.coalesce("gl", F.lit(1)), "gr": F.coalesce("gr", F.lit(1))})
        mine = F.pmod(F.xxhash64(id_col), F.col(own)).cast("int")
        return df.withColumn("a", mine).withColumn("b", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cls", id_col, F.col("a" if own == "gl" else "b").alias("i"), F.col("b" if own == "gl" else "a").alias("j"))

    return gridded(left, "gl", "left_id", "gr").join(gridded(right, "gr", "right_id", "gl"), ["cls", "i", "j"]).select("left_id", "right_id")
