"""Per-key results although a few keys hold most rows: multi-level tree aggregation.

Rows are cut into chunks of a fixed size where they stand; every chunk is combined locally to one state per
key. The chunks are the leaves of a tree: in every round ``fan_in`` neighbouring nodes become one, and the states
that a key has in them are merged, so after ``log(chunks) / log(fan_in)`` rounds each key has one state. No reducer
ever receives all partial states of a key; of a hot key it gets at most ``fan_in`` a round.

Defined results: NULL is a key of its own (``heavy_keys`` drops it); NULL values count as rows but do not enter
sums or extremes; an empty table gives no rows; repeated rows count each; other columns are ignored, also if they
are named like the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: monotonically_increasing_id has the row's place in its partition in the lower bits.
PLACE_BITS = 33


def tree_aggregate(df: DataFrame, keys: list[str], value: str | None = None, chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """``keys``, ``n_rows`` and, with a ``value`` column, ``n_values``, ``total``, ``least``, ``greatest`` per key."""
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2 and chunk_rows at least 1")
    names = [f"_k{i}" for i in range(len(keys))]
    v = F.col(value) if value else F.lit(None).cast("double")
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.alias("_v"))
    leaves = -(-slim.count() // chunk_rows) + 1  # of one partition, at most
    nodes = max(1, slim.rdd.getNumPartitions()) * leaves
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    node = F.shiftright(at, PLACE_BITS) * leaves + F.floor(place / chunk_rows).cast("long")
    states = slim.withColumn("_node", node).groupBy(*names, "_node").agg(
        F.count("*").alias("n_rows"), F.count("_v").alias("n_values"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("greatest")
    )
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        states = states.withColumn("_node", F.floor(F.col("_node") / fan_in).cast("long")).groupBy(*names, "_node").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest")
        )
    results = ["n_rows", "n_values", "total", "least", "greatest"] if value else ["n_rows"]
    return states.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *results)


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """(key_text, n_rows) of the non-empty values of ``key`` on at least ``share`` of all rows of the table."""
    counts = tree_aggregate(df, [key], chunk_rows=chunk_rows, fan_in=fan_in)
    total = df.count()
    return counts.filter(F.col(key).isNotNull() & (F.col(key) != "") & (F.col("n_rows") >= F.lit(total * share))).select(F.col(key).alias("key_text"), "n_rows")
