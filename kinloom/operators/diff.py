"""What differs between the two sides of a pair: extra words, numbers, and how often such differences are noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import kernels as k
from kinloom.functions.text import words
from kinloom.params import VocabParams


def extra(a: Column, b: Column, near_in_a: Column) -> Column:
    """V1: distinct tokens of ``b`` that ``a`` has neither exactly nor nearly; ``near_in_a`` flags the tokens of ``b``."""
    flagged = F.zip_with(b, near_in_a, lambda t, n: F.when(~F.array_contains(a, t) & ~n, t))
    return F.array_distinct(F.filter(flagged, lambda t: t.isNotNull()))


def extra_words(pairs: DataFrame, left: str, right: str, least: int = 85) -> DataFrame:
    """V1 on columns: adds ``x_words`` (only on the right) and ``d_words`` (only on the left)."""
    out = pairs.withColumns({"_a": words(F.col(left)), "_b": words(F.col(right))})
    flags = k.near_flags(least)
    out = out.withColumns({"_nb": flags(F.col("_b"), F.col("_a")), "_na": flags(F.col("_a"), F.col("_b"))})
    return out.withColumns({"x_words": extra(F.col("_a"), F.col("_b"), F.col("_nb")), "d_words": extra(F.col("_b"), F.col("_a"), F.col("_na"))}).drop("_a", "_b", "_na", "_nb")


# Codes of the relations of two first numbers, in order of trial.
NUMBER_RELATIONS = ["equal", "missing", "drop_prefix", "drop_suffix", "add_prefix", "add_suffix", "sub_first", "sub_mid", "sub_last", "multi", "other"]


def number_relation(a: Column, b: Column) -> Column:
    """V2: the code of the relation of two numbers as written (``a`` on the first side)."""
    at = {name: i for i, name in enumerate(NUMBER_RELATIONS)}
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    one = F.when(differ[0] == 1, at["sub_first"]).when(differ[0] == n, at["sub_last"]).otherwise(at["sub_mid"])
    same_length = F.when(F.size(differ) == 1, one).otherwise(at["multi"])
    return (
        F.when((a == "") | (b == ""), at["missing"])
        .when(a == b, at["equal"])
        .when(F.endswith(a, b), at["drop_prefix"])
        .when(F.startswith(a, b), at["drop_suffix"])
        .when(F.endswith(b, a), at["add_prefix"])
        .when(F.startswith(b, a), at["add_suffix"])
        .when(n == F.length(b), same_length)
        .otherwise(at["other"])
        .cast("bigint")
    )


def kinded(kinds: dict[str, str]) -> Column:
    """One array of (kind, token) from the array columns of several kinds."""

    def tag(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    return F.flatten(F.array(*[tag(kind, c) for kind, c in kinds.items()]))


def token_counts(pairs: DataFrame, kinds: dict[str, str], groups: list[str] | None = None) -> DataFrame:
    """(groups, kind, token, n, pos) from array columns of extra words; ``kinds`` maps a kind to its column, ``label`` is summed."""
    rows = pairs.select(*(groups or []), "label", F.explode(kinded(kinds)).alias("x"))
    return rows.groupBy(*(groups or []), F.col("x.kind").alias("kind"), F.col("x.token").alias("token")).agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


def noise_vocabulary(counts: DataFrame, v: VocabParams = VocabParams()) -> DataFrame:
    """V4: smoothed share of true pairs among those that differ by a token, for tokens with enough pairs."""
    return counts.filter(F.col("n") >= v.least_pairs).withColumn("score", F.round((F.col("pos") + v.prior * v.weight) / (F.col("n") + v.weight), 6)).drop("n", "pos")


def crossfit_scores(pairs: DataFrame, kinds: dict[str, str], v: VocabParams = VocabParams(), learn_from: DataFrame | None = None) -> DataFrame:
    """V5: (s1, o, kind, token, score): every pair's extra words scored by the vocabulary of the other fold, in one plan."""
    learned = noise_vocabulary(token_counts(pairs if learn_from is None else learn_from, kinds, ["fold"]), v).select((1 - F.col("fold")).alias("fold"), "kind", "token", "score")
    rows = pairs.select("s1", "o", "fold", F.explode(kinded(kinds)).alias("x")).select("s1", "o", "fold", "x.kind", "x.token")
    return rows.join(learned, ["fold", "kind", "token"], "left").select("s1", "o", "kind", "token", F.coalesce("score", F.lit(v.prior)).alias("score"))


def word_features(scored: DataFrame) -> DataFrame:
    """V6: (s1, o, kind, x_n, x_min, x_mean) of the scores of a pair's extra words."""
    return scored.groupBy("s1", "o", "kind").agg(F.count("*").alias("x_n"), F.min("score").alias("x_min"), F.round(F.avg("score"), 9).alias("x_mean"))


#: The four vocabularies of V4 and the columns of ``extra_by_kind`` they are learned from.
KINDS = {"n_core": "nx", "n_core_d": "nd", "a_norm": "ax", "a_norm_d": "ad"}


def extra_by_kind(pairs: DataFrame) -> DataFrame:
    """V1 on names (``c1``, ``co``) and addresses (``d1``, ``do``): adds nx, nd, ax, ad; no digit tokens in the last two, none where the second text is empty."""
    out = extra_words(pairs, "c1", "co").withColumnsRenamed({"x_words": "nx", "d_words": "nd"})
    out = extra_words(out, "d1", "do").withColumnsRenamed({"x_words": "ax", "d_words": "ad"})
    none = F.array().cast("array<string>")
    of = {"nx": "co", "nd": "co", "ax": "do", "ad": "do"}
    kept = {c: F.filter(c, lambda t: ~t.rlike("^[0-9]+$")) if c[0] == "a" else F.col(c) for c in of}
    return out.withColumns({c: F.when(F.col(of[c]) != "", kept[c]).otherwise(none) for c in of})


def pair_features(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """V6: the 16 features of each pair of ``extra_words`` columns nx, nd, ax, ad, by the scores of ``crossfit_scores``."""
    per = scored.groupBy("s1", "o").agg(
        *[f(F.when(F.col("kind") == kind, F.col("score"))).alias(f"{c}_{n}") for kind, c in KINDS.items() for n, f in (("min", F.min), ("mean", F.avg))]
    )
    both = pairs.join(per, ["s1", "o"], "left")
    addressed = lambda c: F.when(F.col("do") != "", c)
    size = lambda c: F.size(c).cast("bigint")
    share = lambda c: F.round(F.coalesce(c, F.lit(1.0)), 9)
    first = lambda c: F.coalesce(F.get(words(F.col(c)), F.lit(0)), F.lit(""))
    last = lambda c: F.try_element_at(words(F.col(c)), F.lit(-1))
    named, numbered = (F.col("c1") != "") & (F.col("co") != ""), (F.col("m1") != "") & (F.col("mo") != "")
    one = (F.size("nx") == 1) & (F.size("nd") == 1)
    m1, mo = F.array_distinct(words(F.col("m1"))), F.array_distinct(words(F.col("mo")))
    f = {
        "nm_x_n": size("nx"), "nm_x_min": share("nx_min"), "nm_x_mean": share("nx_mean"), "nm_d_n": size("nd"), "nm_d_min": share("nd_min"),
        "ad_x_n": addressed(size("ax")), "ad_x_min": addressed(share("ax_min")), "ad_x_mean": addressed(share("ax_mean")),
        "ad_d_n": addressed(size("ad")), "ad_d_min": addressed(share("ad_min")), "num_rel": number_relation(first("m1"), first("mo")),
        "num_x_n": F.when(numbered, size(F.array_except(mo, m1))), "num_d_n": F.when(numbered, size(F.array_except(m1, mo))),
        "nm_edit": F.when(one, k.pairwise(k.edit_code, T.LongType())(F.get("nd", F.lit(0)), F.get("nx", F.lit(0)))),
        "nm_first_eq": F.when(named, (first("c1") == first("co")).cast("bigint")), "nm_last_eq": F.when(named, (last("c1") == last("co")).cast("bigint")),
    }
    return both.select("s1", "o", *[c.alias(x) for x, c in f.items()])


def calibration_curve(tokens: DataFrame, v: VocabParams = VocabParams()) -> DataFrame:
    """V7: (bin, n, x, y): mean soft score and mean label share per bin, made monotone by a running maximum.

    ``tokens`` has ``soft`` and ``hard``. The bins are few, so the window over them may stand in one place.
    """
    binned = tokens.withColumn("bin", F.least(F.floor(F.col("soft") * v.bins), F.lit(v.bins - 1)).cast("bigint"))
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("soft"), 9).alias("x"), F.round(F.avg("hard"), 9).alias("m")).filter(F.col("n") >= v.least_in_bin)
    w = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("y", F.max("m").over(w)).drop("m")


def interpolate(value: Column, curve: DataFrame) -> Column:
    """linear interpolation on a calibration curve (some ten points), clamped at its ends."""
    points = [(r["x"], r["y"]) for r in curve.orderBy("x").collect()]
    if not points:
        return F.lit(None).cast("double")
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        out = F.when(value <= x1, y0 + (value - x0) * slope).otherwise(out)
    return F.round(F.when(value <= points[0][0], points[0][1]).otherwise(out), 6)


def extend_vocabulary(vocab: DataFrame, unseen: DataFrame, curve: DataFrame) -> DataFrame:
    """V8: vocabulary with tokens that it lacks, scored from their soft share; what it has stays."""
    new = unseen.join(vocab.select("kind", "token"), ["kind", "token"], "left_anti")
    return vocab.select("kind", "token", "score").unionByName(new.select("kind", "token", interpolate(F.col("soft"), curve).alias("score")))
