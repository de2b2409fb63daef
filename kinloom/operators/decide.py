"""From scores to matches: one owner per record, expected-F subsets, id lists, output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.params import DecisionParams


def one_owner(scores: DataFrame, threshold: float) -> DataFrame:
    """The best S1 record of every O record (ties: smaller id), if its score reaches the threshold."""
    first = Window.partitionBy("o").orderBy(F.desc("p"), "s1")
    return scores.withColumn("k", F.row_number().over(first)).filter("k = 1").filter(F.col("p") >= threshold).select("s1", "o", "p")


def expected_f(owned: DataFrame, d: DecisionParams = DecisionParams()) -> DataFrame:
    """Of the records that an S1 record owns, the best-scored k for which the expected F0.5 is greatest.

    No match is worth the probability that none is true. Running sums in score order give all values in one window.
    """
    kept = owned.filter(F.col("p") >= d.floor)
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "o")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("s1")
    out = kept.withColumns({"k": F.row_number().over(w), "top": F.sum("p").over(run), "total": F.sum("p").over(all_), "none": F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))).over(all_)) * d.empty_scale})
    want = F.col("total") + d.missed
    # 1.25 P R / (0.25 P + R) with P = top / k and R = top / want
    out = out.withColumn("value", F.round(1.25 * F.col("top") / (0.25 * want + F.col("k")), 9))
    out = out.withColumn("best", F.max("value").over(all_))
    out = out.withColumn("cut", F.min(F.when(F.col("value") == F.col("best"), F.col("k"))).over(all_))
    return out.filter((F.col("k") <= F.col("cut")) & (F.col("best") > F.round("none", 9))).select("s1", "o", "p")


def id_lists(pairs: DataFrame, ids: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list): sorted comma-joined partners of every S1 id, '' for none."""
    held = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("o")), ",").alias(name))
    out = ids.select(F.col("s1")).join(held, "s1", "left")
    return out.select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def threshold_of(given: float | None, stored: dict | None, default: float = DecisionParams.threshold) -> float:
    """The argument, else the model's, else the default."""
    if given is not None:
        return given
    return float((stored or {}).get("threshold", default))


def outputs(stage2: DataFrame, scores: DataFrame, ids: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The matches and the candidates, each as id lists."""
    return id_lists(one_owner(scores, threshold), ids), id_lists(stage2.select("s1", "o").distinct(), ids, "candidate_entity_ids")
