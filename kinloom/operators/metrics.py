"""Macro F0.5 over all S1 records, singletons included, and its sweep over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.params import DecisionParams


def f05(predicted: set, true: set) -> float:
    """1 for rightly none, else 1.25 P R / (0.25 P + R)."""
    if not true:
        return 0.0 if predicted else 1.0
    hit = len(predicted & true)
    if not predicted or not hit:
        return 0.0
    p, r = hit / len(predicted), hit / len(true)
    return 1.25 * p * r / (0.25 * p + r)


def _value(tp: Column, np_: Column, nt: Column) -> Column:
    # with P = tp / np and R = tp / nt the value is 1.25 tp / (0.25 nt + np)
    return F.when((nt == 0) & (np_ == 0), 1.0).otherwise(F.coalesce(F.try_divide(1.25 * tp, 0.25 * nt + np_), F.lit(0.0)))


def macro_f05(predicted: DataFrame, true: DataFrame, ids: DataFrame) -> DataFrame:
    """(n, macro_f05): one union and one aggregation instead of a chain of joins."""
    marked = predicted.select("s1", "o").distinct().select("s1", "o", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(true.select("s1", "o").distinct().select("s1", "o", F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = marked.groupBy("s1", "o").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = pairs.groupBy("s1").agg(F.sum("a").alias("np"), F.sum("b").alias("nt"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    full = ids.select("s1").join(per, "s1", "left").fillna(0)
    return full.agg(F.count("*").alias("n"), F.round(F.avg(_value(F.col("tp"), F.col("np"), F.col("nt"))), 6).alias("macro_f05"))


def sweep(scores: DataFrame, true: DataFrame, ids: DataFrame, d: DecisionParams = DecisionParams()) -> DataFrame:
    """E5: (threshold, macro_f05) for the whole grid in one pass.

    Of every record only the best owner matters, and only with a score from the least threshold on. S1 records without a
    prediction at any threshold are counted, not repeated for each threshold.
    """
    first = Window.partitionBy("o").orderBy(F.desc("p"), "s1")
    best = scores.withColumn("k", F.row_number().over(first)).filter("k = 1").filter(F.col("p") >= min(d.grid)).select("s1", "o", "p")
    truth = true.select("s1", "o").distinct()
    nt = truth.groupBy("s1").agg(F.count("*").alias("nt"))
    hits = best.join(truth.withColumn("t", F.lit(1)), ["s1", "o"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    grid = F.array(*[F.lit(x) for x in d.grid])
    each = hits.withColumn("threshold", F.explode(F.filter(grid, lambda x: x <= F.col("p"))))
    per = each.groupBy("s1", "threshold").agg(F.count("*").alias("np"), F.sum("t").alias("tp"))
    known = ids.select("s1").join(nt, "s1", "left").fillna(0)
    # a record's value without predictions is 1 if it has no truth, else 0; predictions change it
    base = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("nt") == 0, 1.0).otherwise(0.0)).alias("base"))
    change = per.join(known, "s1").withColumn("gain", _value(F.col("tp"), F.col("np"), F.col("nt")) - F.when(F.col("nt") == 0, 1.0).otherwise(0.0))
    gains = change.groupBy("threshold").agg(F.sum("gain").alias("gain"))
    rows = scores.sparkSession.createDataFrame([(x,) for x in d.grid], "threshold double")
    full = rows.join(gains, "threshold", "left").crossJoin(F.broadcast(base))
    return full.select("threshold", F.round((F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("n"), 6).alias("macro_f05"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the greatest value, of equal ones the one with the least threshold."""
    return swept.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def labelled(pairs: DataFrame, true: DataFrame) -> DataFrame:
    """Adds ``label``, 1 for true pairs, 0 for all others."""
    hit = true.select("s1", "o").distinct().withColumn("label", F.lit(1).cast("bigint"))
    return pairs.join(hit, ["s1", "o"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("bigint")))
