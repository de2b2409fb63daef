"""Candidate pairs by rarity-weighted composite keys.

Records have ``id``, ``country``, ``side`` (1: the register, 0: the others), ``n_core``, ``n_alt``, ``a_norm``, ``a_nums``. Keys are
always joined together with the country, never partitioned by country alone; frequency caps precede the pair join, so a
composite key yields at most ``cap1 * capo`` rows however common its parts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import words
from kinloom.params import BlockingParams
from kinloom.session import BucketedTable, materialize, scratch


def _prefixed(letter: str, values: Column) -> Column:
    return F.transform(values, lambda w: F.concat(F.lit(letter + ":"), w))


def key_array(core: Column, alt: Column, address: Column, numbers: Column) -> Column:
    """B1: all distinct keys of a record, with a one-letter type."""
    names = F.concat(words(core), words(alt))
    compact = F.regexp_replace(core, " ", "")
    grams = F.when(
        F.length(compact) >= 6,
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(compact) - 3, F.lit(1))), lambda i: F.substring(compact, i, F.lit(4))),
    ).otherwise(F.array().cast("array<string>"))
    digits = r"^[0-9]+$"
    return F.array_distinct(
        F.concat(
            _prefixed("W", F.filter(names, lambda w: F.length(w) >= 2)),
            _prefixed("P", F.transform(F.filter(names, lambda w: F.length(w) >= 7), lambda w: F.substring(w, 1, 5))),
            _prefixed("C", F.filter(F.array(compact), lambda w: F.length(w) >= 5)),
            _prefixed("G", grams),
            _prefixed("A", F.filter(words(address), lambda w: ~w.rlike(digits) & ((F.length(w) >= 3) | w.rlike("[0-9]")))),
            _prefixed("N", F.filter(words(numbers), lambda w: F.length(w) >= 2)),
        )
    )


def block_keys(records: DataFrame) -> DataFrame:
    """B1: (id, side, country, key), distinct, in one pass over the records."""
    keys = key_array(F.col("n_core"), F.col("n_alt"), F.col("a_norm"), F.col("a_nums"))
    return records.select("id", "side", "country", F.explode(keys).alias("key"))


def key_stats(keys: DataFrame, key: str = "key") -> DataFrame:
    """B2: (country, key, df1, dfo) of the keys on both sides: one conditional count, no join."""
    side1 = F.col("side") == 1
    counted = keys.groupBy("country", key).agg(F.count(F.when(side1, 1)).alias("df1"), F.count(F.when(~side1, 1)).alias("dfo"))
    return counted.filter("df1 > 0 and dfo > 0")


def key_type(key: Column) -> Column:
    head = F.substring(key, 1, 1)
    return F.when(head.isin("W", "P", "C"), "n").when(head == "G", "g").otherwise("a")


def rare_keys(keys: DataFrame, stats: DataFrame, p: BlockingParams = BlockingParams()) -> DataFrame:
    """(id, side, country, key, typ, df1, rn): the rarest keys of every record and type, within the budgets."""
    typed = keys.join(stats, ["country", "key"]).withColumn("typ", key_type(F.col("key")))
    w = Window.partitionBy("side", "id", "typ").orderBy("df1", "dfo", "key")
    most = max(p.nk, p.nk1, p.na, p.na1, p.ng, p.ng1)
    # a constant limit first, so that the window keeps only that many rows per group while it sorts
    ranked = typed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    one = F.col("side") == 1
    budget = (
        F.when(F.col("typ") == "n", F.when(one, p.nk1).otherwise(p.nk))
        .when(F.col("typ") == "g", F.when(one, p.ng1).otherwise(p.ng))
        .otherwise(F.when(one, p.na1).otherwise(p.na))
    )
    return ranked.filter(F.col("rn") <= budget).select("id", "side", "country", "key", "typ", "df1", F.col("rn").cast("bigint").alias("rn"))


def composite_keys(rare: DataFrame, p: BlockingParams = BlockingParams()) -> DataFrame:
    """(id, side, country, ck): pairs of a record's rare keys, and its very rare keys alone. No self-join: a
    record's few keys are one array."""
    item = F.struct("key", "typ", "rn", "df1")
    held = rare.groupBy("id", "side", "country").agg(F.array_sort(F.collect_list(item)).alias("ks"))
    limit = F.when(F.col("side") == 1, p.naa1).otherwise(p.naa)

    def fits(a: Column, b: Column) -> Column:
        both_a = (a["typ"] == "a") & (b["typ"] == "a")
        mixed = (a["typ"] == "g") != (b["typ"] == "g")
        return (a["key"] < b["key"]) & ~mixed & (~both_a | ((a["rn"] <= limit) & (b["rn"] <= limit)))

    pairs = F.flatten(F.transform("ks", lambda a: F.transform(F.filter("ks", lambda b: fits(a, b)), lambda b: F.concat(a["key"], F.lit("|"), b["key"]))))
    alone = F.transform(F.filter("ks", lambda a: a["df1"] <= p.single_df), lambda a: a["key"])
    return held.select("id", "side", "country", F.explode(F.array_distinct(F.concat(pairs, alone))).alias("ck"))


def composite_weights(composites: DataFrame, p: BlockingParams = BlockingParams()) -> DataFrame:
    """(country, ck, df1, dfo, w) within the caps."""
    stats = key_stats(composites, "ck").filter((F.col("df1") <= p.cap1) & (F.col("dfo") <= p.capo))
    return stats.withColumn("w", F.log(1 + F.lit(1e6) / F.col("dfo")))


def pair_estimate(weights: DataFrame) -> DataFrame:
    """Raw pairs that the join will make, per country; a guard before it runs."""
    return weights.groupBy("country").agg(F.sum(F.col("df1") * F.col("dfo")).cast("bigint").alias("raw_pairs"))


def _weighted_pairs(composites: DataFrame, weights: DataFrame) -> DataFrame:
    """(s1, o, w): a row for each shared composite key."""
    slim = weights.select("country", "ck", "w")
    left = composites.filter("side = 1").join(slim, ["country", "ck"]).select("country", "ck", F.col("id").alias("s1"), "w")
    right = composites.filter("side = 0").join(slim.drop("w"), ["country", "ck"], "left_semi").select("country", "ck", F.col("id").alias("o"))
    return left.join(right, ["country", "ck"]).select("s1", "o", "w")


def _summed(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("s1", "o").agg(F.round(F.sum("w"), 6).alias("bscore"), F.count("*").alias("nk"))


def pair_scores(composites: DataFrame, weights: DataFrame) -> DataFrame:
    """(s1, o, bscore, nk): summed weights and number of shared composite keys."""
    return _summed(_weighted_pairs(composites, weights))


def select_candidates(scores: DataFrame, p: BlockingParams = BlockingParams()) -> DataFrame:
    """The best of every record of either side, with ranks among the selected and figures over all pairs."""
    by_o, by_1 = Window.partitionBy("o"), Window.partitionBy("s1")
    first_o, first_1 = by_o.orderBy(F.desc("bscore"), "s1"), by_1.orderBy(F.desc("bscore"), "o")
    seen = scores.withColumns({"mo": F.max("bscore").over(by_o), "n_o": F.count("*").over(by_o), "k_o": F.row_number().over(first_o)})
    seen = seen.withColumns({"m1": F.max("bscore").over(by_1), "n_1": F.count("*").over(by_1), "k_1": F.row_number().over(first_1)})
    kept = seen.filter((F.col("k_o") <= p.k_o) | (F.col("k_1") <= p.k_1))
    kept = kept.withColumn("r_1", F.row_number().over(first_1).cast("bigint")).withColumn("r_o", F.row_number().over(first_o).cast("bigint"))
    return kept.select("s1", "o", "bscore", "nk", "r_o", "r_1", F.round(F.col("bscore") / F.col("mo"), 6).alias("rel_o"), F.round(F.col("bscore") / F.col("m1"), 6).alias("rel_1"), "n_o", "n_1")


#: Records from which on the steps go over parts of their input, and the number of the parts.
WHOLE, PARTS = 100_000, 8


def scored(records: DataFrame, p: BlockingParams = BlockingParams(), whole: int = WHOLE, parts: int = PARTS) -> DataFrame:
    """B1 to B7 over all records, as :func:`pair_scores` gives them, with a share of the shuffle files on disk at a time.

    Beyond ``whole`` records, keys are made for one part of the records after the other, composite keys are joined for one
    part of them after the other, and weights are summed for one part of the left side after the other; what a step
    has read is deleted. Nothing is left out: parts are by hash, and each has all rows of its records, keys or pairs.
    """
    spark = records.sparkSession
    with scratch(spark):
        recs = materialize(records.select("id", "side", "country", "n_core", "n_alt", "a_norm", "a_nums"), "records")
        n = parts if recs.count() > whole else 1
        of = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
        stats = materialize(key_stats(block_keys(recs)), "key-stats")
        composites = BucketedTable(spark, "composites", n)
        for k in range(n):
            few = recs.filter(of("side", "id") == k)
            made = composite_keys(rare_keys(block_keys(few), stats, p), p)
            composites.add(made.withColumn("bucket", of("country", "ck")))
        raw = BucketedTable(spark, "raw-pairs", n)
        for k in range(n):
            some = composites.read(k)
            raw.add(_weighted_pairs(some, materialize(composite_weights(some, p), "weights")).withColumn("bucket", of("s1")))
            composites.drop(k)
        scores = BucketedTable(spark, "pair-scores", 1, keep=True)
        for k in range(n):
            scores.add(_summed(raw.read(k)).withColumn("bucket", F.lit(0)))
            raw.drop(k)
    return scores.read(0)


def candidates(records: DataFrame, p: BlockingParams = BlockingParams()) -> DataFrame:
    """All steps."""
    return select_candidates(scored(records, p), p)


def blocking_recall(truth: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """(country, source, n_true, n_found, recall) of true pairs by country and by the source in the id."""
    hit = truth.join(found.select("s1", "o", F.lit(1).alias("hit")), ["s1", "o"], "left")
    placed = hit.join(records.filter("side = 0").select(F.col("id").alias("o"), "country"), "o").withColumn("source", F.substring("o", 1, 2))
    agg = [F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")]
    return placed.groupBy("country", "source").agg(*agg)
