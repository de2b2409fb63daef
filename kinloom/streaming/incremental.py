"""New records against a static register, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.operators.blocking import key_array


def register_keys(register: DataFrame, most: int = 30) -> DataFrame:
    """(country, key, s1, w): the register's keys that at most ``most`` records have, with a weight by rarity."""
    keys = key_array(F.col("n_core"), F.col("n_alt"), F.col("a_norm"), F.col("a_nums"))
    rows = register.select(F.col("id").alias("s1"), "country", F.explode(keys).alias("key"))
    df = rows.groupBy("country", "key").agg(F.count("*").alias("df")).filter(F.col("df") <= most)
    return rows.join(df, ["country", "key"]).select("country", "key", "s1", F.log(1 + F.lit(1e6) / F.col("df")).alias("w"))


def arriving_pairs(stream: DataFrame, keys: DataFrame) -> DataFrame:
    """(o, s1, key, w): shared keys of arriving records; a stream joined with a static table, so without state."""
    own = key_array(F.col("n_core"), F.col("n_alt"), F.col("a_norm"), F.col("a_nums"))
    rows = stream.select(F.col("id").alias("o"), "country", F.explode(own).alias("key"))
    return rows.join(keys, ["country", "key"]).select("o", "s1", "key", "w")


def owners_of(pairs: DataFrame) -> DataFrame:
    """(o, s1, score): the best register record of every O record of a batch; the smaller s1 among equals."""
    scores = pairs.groupBy("o", "s1").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.groupBy("o").agg(F.min_by("s1", F.struct(-F.col("score"), "s1")).alias("s1"), F.max("score").alias("score"))


def start(stream: DataFrame, keys: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the owners of every micro-batch to ``out``; a batch that is run again overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        owners_of(arriving_pairs(df, keys)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
