"""Features of a pair among the other pairs of its records. Edges have ``s1``, ``o`` and the score ``p``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import kernels as k
from kinloom.operators.ranks import ranked
from kinloom.params import DecisionParams, StageParams
from kinloom.session import evenly


def plausible(edges: DataFrame, d: DecisionParams = DecisionParams()) -> DataFrame:
    """The edges that group features are made of: those with a score of at least ``p_min``."""
    return edges.filter(F.col("p") >= d.p_min)


def competition(edges: DataFrame, p: StageParams = StageParams()) -> DataFrame:
    """The other candidates of either record, among plausible edges.

    Figures of a record come from aggregations that combine before the shuffle, as one record may have a third of all edges.
    """
    out = ranked(plausible(edges), "o", [F.desc("p"), F.asc("s1")], "o_rank")
    of_o = out.groupBy("o").agg(
        F.max("p").alias("o_best"), F.count(F.when(F.col("p") >= p.plausible, 1)).alias("o_n_plaus"), F.coalesce(F.max(F.when(F.col("o_rank") == 2, F.col("p"))), F.lit(0.0)).alias("o_second")
    )
    of_1 = out.groupBy("s1").agg(F.count(F.when(F.col("p") >= p.confident, 1)).alias("s1_n_conf"), F.round(F.sum("p"), 6).alias("s1_sum_p"), F.max("p").alias("s1_max_p"))
    out = out.join(of_o, "o").join(of_1, "s1").withColumn("o_best_other", F.when(F.col("o_rank") == 1, F.col("o_second")).otherwise(F.col("o_best")))
    return out.withColumn("o_margin", F.round(F.col("p") - F.col("o_best_other"), 6))


def mean6(x: Column) -> Column:
    """The mean of figures of six digits, to six digits, halves upwards: in whole numbers, so that it does not depend on the order of rows."""
    n = F.count(x)
    return F.floor((2 * F.sum(F.round(x * 1_000_000).cast("bigint")) + n) / (2 * n)) / 1_000_000


def logit(p: Column) -> Column:
    """G5."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.round(F.log(q / (1 - q)), 6)


def twins(records: DataFrame) -> DataFrame:
    """How many other O records bear the same name, and the same name and first number, in whatever country.

    Counts come from an aggregation that combines before the shuffle, not from windows over whole groups, as a name may
    be borne by a third of all records.
    """
    first = F.coalesce(F.try_element_at(F.split("a_nums", " "), F.lit(1)), F.lit(""))
    keyed = records.filter("side = 0").select("id", "n_core", first.alias("num"))
    pairs = keyed.groupBy("n_core", "num").agg(F.count("*").alias("n_key"))
    names = pairs.groupBy("n_core").agg(F.sum("n_key").alias("n_name"))
    return keyed.join(pairs.join(names, "n_core"), ["n_core", "num"]).select("id", (F.col("n_name") - 1).alias("twin_name"), (F.col("n_key") - 1).alias("twin_key"))


def siblings(edges: DataFrame, records: DataFrame, p: StageParams = StageParams()) -> DataFrame:
    """How alike an O record is to the other records that fit the same S1 record with some confidence.

    ``records`` has ``o``, ``n_core`` and ``a_norm``. An address that is empty on a side is not alike at all. Pairs without
    siblings have counts of 0 and missing likeness.
    """
    edges = plausible(edges)
    sure = edges.filter(F.col("p") >= p.sibling).select("s1", F.col("o").alias("o2"), F.col("p").alias("p2"))
    near = edges.select("s1", "o").join(sure, "s1").filter("o <> o2")
    a = records.select("o", F.col("n_core").alias("na"), F.col("a_norm").alias("aa"))
    b = records.select(F.col("o").alias("o2"), F.col("n_core").alias("nb"), F.col("a_norm").alias("ab"))
    full = evenly(near.join(a, "o").join(b, "o2"))
    full = full.withColumns({"nm": F.round(k.pairwise(k.token_sort_ratio)("na", "nb"), 6), "ad": F.round(k.pairwise(k.token_set_ratio)("aa", "ab"), 6)})
    full = full.withColumn("both", F.least("nm", "ad"))
    close = (F.col("nm") >= 90) & (F.col("ad") >= 80)
    agg = full.groupBy("s1", "o").agg(
        F.count("*").alias("sib_n"), F.max("nm").alias("sib_nm_max"), F.max("ad").alias("sib_ad_max"), F.max("both").alias("sib_both_max"),
        mean6(F.col("nm")).alias("sib_nm_mean"), F.count(F.when(close, 1)).alias("sib_close"), F.max(F.when(close, F.col("p2")).otherwise(0.0)).alias("sib_close_p"),
        F.round(F.sum(F.col("both") * F.col("p2")) / F.sum("p2"), 6).alias("sib_wsim"),
    )
    return edges.select("s1", "o").join(agg, ["s1", "o"], "left").fillna(0, ["sib_n", "sib_close"])


#: The ten features of the blend.
BLEND = ("lp", "ce", "ce_o_max", "ce_o_n", "ce_gap_o", "p_gap_o", "ce_o_second", "ce_s1_max", "ce_s1_mean", "ce_gap_s1")


def blend_features(scores: DataFrame) -> DataFrame:
    """The second scorer's result ``ce`` beside ``p``, and how both compare with the record's other pairs."""
    placed = ranked(scores.select("s1", "o", "p", "ce"), "o", [F.desc("ce"), F.asc("s1")], "k")
    of_o = placed.groupBy("o").agg(
        F.max("ce").alias("ce_o_max"), F.count("*").alias("ce_o_n"), F.max("p").alias("p_max"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("ce"))), F.lit(-20.0)).alias("ce_o_second")
    )
    of_1 = placed.groupBy("s1").agg(F.max("ce").alias("ce_s1_max"), mean6(F.col("ce")).alias("ce_s1_mean"))
    out = placed.join(of_o, "o").join(of_1, "s1").withColumns(
        {"lp": logit(F.col("p")), "ce_gap_o": F.round(F.col("ce") - F.col("ce_o_max"), 6), "p_gap_o": F.round(F.col("p") - F.col("p_max"), 6), "ce_gap_s1": F.round(F.col("ce") - F.col("ce_s1_max"), 6)}
    )
    return out.select("s1", "o", "p", *BLEND)
