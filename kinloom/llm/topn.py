"""Problem 3: top N items of every group, by statistics-guided skipping of row groups.

The pairs are laid out once, clustered by group and, inside a group, by falling score. The layout is a range
partitioning on (group, score, item), so a group with millions of items spreads over many files of even size. Every
Parquet row group then has, in its footer, the groups it spans and its greatest and least score. A row group that
holds one group only is skipped without being read if its greatest score is strictly below the group's N-th score as
the statistics of other row groups prove it; the rest are read in the order of falling greatest score, and are
skipped as soon as what was read of their file proves the same. What every file leaves, N per group at most,
is merged at the end. Equal scores are never skipped, so the tie rule (smaller item first) holds.

Defined results: rows whose group, item or score is NULL or whose score is NaN are ignored; a pair in several rows
counts once with its highest score; fewer than N items give fewer rows; N below 1 is an error; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.session import fresh_path


def _open(uri: str) -> pq.ParquetFile:
    if uri.startswith("file:"):
        return pq.ParquetFile("/" + uri.removeprefix("file:").lstrip("/"))
    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


def cluster_by_group(df: DataFrame, group: str, item: str, score: str, path: str, row_group_bytes: int = 1 << 20) -> None:
    """Writes (g, i, s), one row per pair with its highest score, in the clustered layout."""
    pairs = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"))
    pairs = pairs.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    best = pairs.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = [F.asc("g"), F.desc("s"), F.asc("i")]
    laid = best.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes)).option("compression", "zstd").parquet(path)


def row_group_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(file, rg, n_rows, low_g, high_g, low_s, high_s) from the footers, read on the executors."""
    files = spark.read.parquet(path).inputFiles()
    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("rg", T.IntegerType()), T.StructField("n_rows", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("low_g", "high_g")]
        + [T.StructField(c, T.DoubleType()) for c in ("low_s", "high_s")]
    )

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uri in pdf["file"]:
                with _open(uri) as f:
                    meta = f.metadata
                    at = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
                    for k in range(meta.num_row_groups):
                        rg = meta.row_group(k)
                        g, s = rg.column(at["g"]).statistics, rg.column(at["s"]).statistics
                        known_g = (g.min, g.max) if g is not None and g.has_min_max else (None, None)
                        known_s = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                        rows.append((uri, k, rg.num_rows, *known_g, *known_s))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    listed = spark.createDataFrame([(f,) for f in files], "file string") if files else spark.createDataFrame([], "file string")
    return listed.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(footers, schema)


def surviving_row_groups(stats: DataFrame, n: int) -> DataFrame:
    """(file, rgs): of every file the row groups to read, in falling order of their greatest score.

    A row group with one group only and at least ``n`` rows proves that the group's N-th score is not below its least score.
    """
    single = F.col("low_g") == F.col("high_g")
    proof = stats.filter(single & (F.col("n_rows") >= n)).groupBy(F.col("low_g").alias("p_g")).agg(F.max("low_s").alias("bound"))
    kept = stats.join(proof, single & (F.col("low_g") == F.col("p_g")), "left").filter(F.col("bound").isNull() | F.col("high_s").isNull() | (F.col("high_s") >= F.col("bound")))
    item = F.struct(F.coalesce(-F.col("high_s"), F.lit(float("-inf"))).alias("o"), "rg", "low_g", "high_g", "high_s")
    return kept.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("rgs"))


def top_n_from_layout(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(g, i, s, rank) of the N first items of every group in a clustered layout."""
    todo = surviving_row_groups(row_group_statistics(spark, path), n)
    # a file is a task's least share; by rows, as a partitioning by file would be merged with the one before
    files = todo.repartition(max(1, min(len(spark.read.parquet(path).inputFiles()), 20_000)))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("i", T.StringType()), T.StructField("s", T.DoubleType())])

    def best(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable")
        return df[df.groupby("g", sort=False).cumcount() < n]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, rgs in zip(pdf["file"], pdf["rgs"], strict=True):
                held: pd.DataFrame | None = None
                with _open(uri) as f:
                    for rg in rgs:
                        if held is not None and rg["low_g"] is not None and rg["low_g"] == rg["high_g"]:
                            own = held.loc[held["g"] == rg["low_g"], "s"]
                            if len(own) >= n and rg["high_s"] < own.min():
                                continue
                        rows = f.read_row_group(rg["rg"], columns=["g", "i", "s"]).to_pandas()
                        held = best(rows if held is None else pd.concat([held, rows], ignore_index=True))
                if held is not None:
                    yield held

    partial = files.mapInPandas(read, schema)
    w = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = 1 << 20) -> DataFrame:
    """Lays ``df`` out in the shared folder and takes the N best items of every group: (g, i, s, rank)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    path = fresh_path(df.sparkSession, "clustered")
    cluster_by_group(df, group, item, score, path, row_group_bytes)
    return top_n_from_layout(df.sparkSession, path, n)
