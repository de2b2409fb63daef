"""Sources and sinks: text tables without quoting, parquet, stage seams, JSON artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """IO1 and IO6: tab-separated, no quoting, all strings, missing as ''. Without a schema the header names the columns."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path).na.fill("")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """IO2: parquet or text by the name's end."""
    return read_tsv(spark, path, schema) if path.rstrip("/").endswith((".tsv", ".txt", ".csv")) else spark.read.parquet(path)


def read_many(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """IO3 and IO4: only the named columns of several parquet tables."""
    out = spark.read.parquet(paths[0]).select(*columns)
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p).select(*columns))
    return out


def has_column(spark: SparkSession, path: str, name: str) -> bool:
    """IO7: from metadata only."""
    return name in spark.read.parquet(path).columns


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """IO10: one tab-separated file with a header and no quoting; for results, not for stage seams."""
    out = df.orderBy(order) if order else df
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def write_export(df: DataFrame, path: str, level: int = 19) -> None:
    """IO9: parquet packed hard."""
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """IO8 and IO13: the table at ``path`` if it was written completely, else built and written there."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """IO11: a small artifact on any file system Spark knows."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def explode_truth(df: DataFrame) -> DataFrame:
    """(s1, o) from comma-joined lists; '' is a record without a match."""
    listed = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col("source1_entity_id").alias("s1"), F.explode(listed).alias("o"))


def attach_vector(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """IO14: scores joined by their row number, never by position."""
    return pairs.join(scores, "row")
