"""Session building and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "kinloom", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own
    (tests); on a cluster there is no folder that all executors would see, so that is an error."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kinloom/{label}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, unless they were made with ``keep``: for the steps towards one result."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.remove(own)
        for uri in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Removes the shuffle files of a query when it has ended, where this Spark version has the setting.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files: what they made is in the table they wrote."""
    try:
        before = spark.conf.get(CLEANUP_KEY)  # with a default of None it would be None wherever nobody has set it
    except Exception:  # noqa: BLE001 - not a setting of this version
        before = None
    if before is not None:
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP_KEY, before)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that any executor can reread."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _scratch and not keep:
        _scratch[-1].append(path)
    with _shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A table in the shared folder that is written in several turns and read and deleted by ``bucket``, an integer column from 0 to ``n - 1``."""

    def __init__(self, spark: SparkSession, label: str, n: int, keep: bool = False) -> None:
        self.spark, self.n, self.path, self.schema = spark, n, fresh_path(spark, label), None
        if _scratch and not keep:
            _scratch[-1].append(self.path)

    def add(self, df: DataFrame) -> None:
        self.schema = df.drop("bucket").schema
        with _shuffles_removed(self.spark):
            if self.n > 1:
                df.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(self.path)
            else:
                df.drop("bucket").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/bucket=0")

    def _folder(self, k: int):  # noqa: ANN202 - a Hadoop path and its file system
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={k}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, k: int) -> DataFrame:
        path, system = self._folder(k)
        if not system.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/bucket={k}")

    def drop(self, k: int) -> None:
        path, system = self._folder(k)
        system.delete(path, True)


def evenly(df: DataFrame) -> DataFrame:
    """Even tasks for rows that cost much each, where the size in bytes would merge them into few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
