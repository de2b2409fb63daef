"""Learning spellings of native-script words from true pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import kernels as k
from kinloom.functions.text import romanise

INDIC = r"[\x{0900}-\x{0DFF}]"
# Letters and digraphs of like sound, in order of application.
SOUNDS = [("ph", "f"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("sh", "s"), ("ch", "c"), ("w", "v"), ("z", "j"), ("q", "k"), ("x", "ks"), ("y", "i")]


def native_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, o, native, latin) for name and address of true pairs whose O text has native letters."""
    left = records.filter("side = 1").select(F.col("id").alias("s1"), F.col("business_name").alias("n1"), F.col("business_address").alias("a1"))
    right = records.filter("side = 0").select(F.col("id").alias("o"), F.col("business_name").alias("no"), F.col("business_address").alias("ao"))
    both = truth.join(left, "s1").join(right, "o")
    item = F.array(F.struct(F.col("no").alias("native"), F.col("n1").alias("latin")), F.struct(F.col("ao").alias("native"), F.col("a1").alias("latin")))
    return both.select("s1", "o", F.posexplode(item).alias("field", "x")).select("s1", "o", "field", "x.native", "x.latin").filter(F.col("native").rlike(INDIC))


def split_words(col: Column) -> Column:
    """T2."""
    return F.filter(F.split(col, r"[\s,.;:/()\[\]&+#'\"-]+"), lambda w: w != "")


def rough(col: Column) -> Column:
    """Romanised by letters, only a-z and 0-9."""
    return F.regexp_replace(romanise(col), "[^a-z0-9]", "")


def skeleton(col: Column) -> Column:
    """T4: like sounds alike, vowels only in front, no repeats."""
    out = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SOUNDS, col)
    out = F.concat(F.substring(out, 1, 1), F.regexp_replace(F.substring(out, F.lit(2), F.length(out)), "[aeiou]", ""))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def alignments(pairs: DataFrame, least: float = 55.0) -> DataFrame:
    """T5: (native, latin) of the best aligned word of the Latin side for every native word of a pair."""
    sides = pairs.withColumns({"nw": split_words(F.col("native")), "lw": split_words(F.lower(F.col("latin")))})
    left = sides.select("s1", "o", "field", F.size("nw").alias("ln"), F.size("lw").alias("ll"), "lw", F.posexplode("nw").alias("i", "w")).filter(F.col("w").rlike(INDIC))
    both = left.select("s1", "o", "field", "ln", "ll", "i", "w", F.posexplode("lw").alias("j", "v")).filter(~F.col("v").rlike("[0-9]"))
    both = both.withColumns({"rw": rough(F.col("w")), "rv": rough(F.col("v"))})
    ratio = k.pairwise(k.ratio)
    both = both.withColumn("score", F.greatest(ratio(F.col("rw"), F.col("rv")), ratio(skeleton(F.col("rw")), skeleton(F.col("rv")))) + F.when((F.col("i") == F.col("j")) & (F.col("ln") == F.col("ll")), 15.0).otherwise(0.0))
    w = Window.partitionBy("s1", "o", "field", "i").orderBy(F.desc("score"), "j")
    return both.withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) & (F.col("score") >= least)).select(F.col("w").alias("token"), F.col("rv").alias("latin"))


def votes(aligned: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(token, latin): the spelling that most pairs give a word, with enough of them and at least half."""
    counts = aligned.groupBy("token", "latin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("token")
    ranked = counts.withColumns({"k": F.row_number().over(w.orderBy(F.desc("n"), "latin")), "total": F.sum("n").over(w)})
    return ranked.filter((F.col("k") == 1) & (F.col("n") >= least) & (F.col("n") >= F.col("total") * share)).select("token", "latin", "n", "total")


def learn(truth: DataFrame, records: DataFrame) -> DataFrame:
    return votes(alignments(native_pairs(truth, records)))
