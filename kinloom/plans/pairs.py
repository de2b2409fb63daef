"""Queries on candidate pairs: features, competition, decision, metric, vocabulary, models; and their SQL.

Pairs are those of ``cand`` with a usable score, once each with their highest one; ``p`` grows with it from 0 to 1.
True pairs are those whose records have the same words in name and address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import kernels as k
from kinloom.functions.hashing import fold, fold_sql
from kinloom.functions.text import clean_addr, squeeze, words
from kinloom.operators import decide, diff, features, group, metrics, models, ranks
from kinloom.operators.blocking import candidates as blocking_candidates
from kinloom.params import DecisionParams, StageParams, VocabParams
from kinloom.plans.blocking import pseudo_truth
from kinloom.plans.records import REC_HUB, normed, records, table
from kinloom.session import evenly, materialize

GRID = DecisionParams().grid


def edges(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "cand").filter("bscore is not null and not isnan(bscore) and s1 is not null and o is not null")
    best = ok.groupBy("s1", "o").agg(F.max("bscore").alias("s"))
    return best.select("s1", "o", F.round(F.greatest(F.lit(0.0), F.col("s") / (F.abs("s") + 20)), 6).alias("p"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return pseudo_truth(records(spark, d, hub=True))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "s1").select(F.col("entity_id").alias("s1"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Edges with names, addresses and numbers of both sides."""
    return features.attach(edges(spark, d), records(spark, d, hub=True), {"n_core": "c", "a_norm": "d", "a_nums": "m"})


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose names agree word for word count as true here."""
    return _named(spark, d).withColumn("label", F.when((F.col("c1") == F.col("co")) & (F.col("c1") != ""), 1).otherwise(0).cast("bigint"))


def competition(spark: SparkSession, d: str) -> DataFrame:
    return group.competition(edges(spark, d))


def logit_p(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("s1", "o", group.logit(F.col("p")).alias("logit_p"))


def twins(spark: SparkSession, d: str) -> DataFrame:
    return group.twins(records(spark, d))


def siblings(spark: SparkSession, d: str) -> DataFrame:
    recs = records(spark, d, hub=True).filter("side = 0").select(F.col("id").alias("o"), "n_core", "a_norm")
    return group.siblings(edges(spark, d), recs)


def blend_features(spark: SparkSession, d: str) -> DataFrame:
    scored = edges(spark, d).withColumn("ce", F.round(F.col("p") * 10 - 5, 6))
    return group.blend_features(scored)


def one_owner(spark: SparkSession, d: str) -> DataFrame:
    return decide.one_owner(edges(spark, d), 0.5)


def expected_f_decision(spark: SparkSession, d: str) -> DataFrame:
    return decide.expected_f(decide.one_owner(edges(spark, d), 0.0)).select("s1", "o")


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    return decide.id_lists(decide.one_owner(edges(spark, d), 0.5), _ids(spark, d))


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    return decide.outputs(edges(spark, d), edges(spark, d), _ids(spark, d), 0.5)[1]


def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f05(decide.one_owner(edges(spark, d), 0.5), _truth(spark, d), _ids(spark, d))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sweep(edges(spark, d), _truth(spark, d), _ids(spark, d))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """The part of each pair: held out with its records, for training, or neither."""
    p = StageParams()
    e = edges(spark, d).select("s1", "o").withColumn("h", fold(F.col("s1"), p.holdout_seed, 100) < p.holdout_percent)
    held = e.filter("h").select("o").distinct().withColumn("seen", F.lit(True))
    out = e.join(held, "o", "left")
    return out.select("s1", "o", F.when(F.col("seen"), "hold").otherwise("train").alias("part"))


def pair_texts(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    return n.select("s1", "o", F.concat_ws(" | ", "c1", "d1").alias("a"), F.concat_ws(" | ", "co", "do").alias("b"))


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    return n.select("s1", "o", *[c.alias(x) for s, a, b in (("nm", "c1", "co"), ("ad", "d1", "do")) for x, c in features.overlap(F.col(a), F.col(b), s).items()])


def number_features(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("s1", "o", *[c.alias(x) for x, c in features.number_features(F.col("m1"), F.col("mo")).items()])


def pair_flags(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    return n.select("s1", "o", *[c.alias(x) for x, c in features.flags(F.col("c1"), F.col("co"), F.col("do"), F.col("o")).items()])


def idf_tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.document_frequencies(records(spark, d), "n_core")


def fuzzy_coverage(spark: SparkSession, d: str) -> DataFrame:
    recs = records(spark, d, hub=True)
    weights = features.token_weights(recs, "n_core", features.document_frequencies(recs, "n_core"))
    return features.fuzzy_coverage(edges(spark, d).select("s1", "o"), weights)


def sim_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evenly(_named(spark, d)).select("s1", "o", F.round(k.pairwise(k.ratio)(F.col("c1"), F.col("co")), 6).alias("nm_ratio"))


def sim_token_sort(spark: SparkSession, d: str) -> DataFrame:
    return evenly(_named(spark, d)).select("s1", "o", F.round(k.pairwise(k.token_sort_ratio)(F.col("c1"), F.col("co")), 6).alias("nm_tsort"))


def sim_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return evenly(_named(spark, d)).select("s1", "o", F.round(k.pairwise(k.jaro_winkler)(F.col("c1"), F.col("co")), 6).alias("nm_jw"))


def sim_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("s1", "o", F.levenshtein("c1", "co").cast("bigint").alias("edits"))


def similarities(spark: SparkSession, d: str) -> DataFrame:
    n = evenly(_named(spark, d))
    return n.select("s1", "o", *[c.alias(x) for x, c in (features.name_similarities(F.col("c1"), F.col("co")) | features.address_similarities(F.col("d1"), F.col("do"))).items()])


def number_relation(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.coalesce(F.try_element_at(F.split(c, " "), F.lit(1)), F.lit(""))
    return _named(spark, d).select("s1", "o", diff.number_relation(first(F.col("m1")), first(F.col("mo"))).alias("num_rel"))


def extra_words(spark: SparkSession, d: str) -> DataFrame:
    x = diff.extra_words(evenly(_named(spark, d)), "c1", "co")
    return x.select("s1", "o", F.array_join(F.array_sort("x_words"), " ").alias("x_words"), F.array_join(F.array_sort("d_words"), " ").alias("d_words"))


def edit_codes(spark: SparkSession, d: str) -> DataFrame:
    """V3 where exactly one word is extra and one is missing."""
    x = diff.extra_words(evenly(_named(spark, d)), "c1", "co").filter("size(x_words) = 1 and size(d_words) = 1")
    from pyspark.sql import types as T

    return x.select("s1", "o", k.pairwise(k.edit_code, T.LongType())(F.col("d_words")[0], F.col("x_words")[0]).alias("nm_edit"))


KINDS = {"n_core": "nx", "n_core_d": "nd"}


def _plain_extra(spark: SparkSession, d: str) -> DataFrame:
    """Labelled edges with the words that only one side has, without the near ones' exception."""
    n = _labelled(spark, d).withColumns({"a": F.array_distinct(words(F.col("c1"))), "b": F.array_distinct(words(F.col("co")))})
    n = n.withColumns({"nx": F.array_except("b", "a"), "nd": F.array_except("a", "b"), "fold": fold(F.col("s1"), StageParams.fold_seed, 2)})
    # a pair is true here if its addresses have a common number
    return n.withColumn("label", F.when(F.arrays_overlap(words(F.col("m1")), words(F.col("mo"))), 1).otherwise(0).cast("bigint"))


def noise_vocab(spark: SparkSession, d: str) -> DataFrame:
    return diff.noise_vocabulary(diff.token_counts(_plain_extra(spark, d), KINDS))


def noise_vocab_crossfit(spark: SparkSession, d: str) -> DataFrame:
    return diff.crossfit_scores(_plain_extra(spark, d), KINDS)


def word_features(spark: SparkSession, d: str) -> DataFrame:
    return diff.word_features(noise_vocab_crossfit(spark, d))


def _soft(spark: SparkSession, d: str) -> DataFrame:
    """(kind, token, n, soft, hard): mean score and mean label of the pairs that differ by a token."""
    x = _plain_extra(spark, d)
    rows = x.select("p", "label", F.explode(diff.kinded(KINDS)).alias("x"))
    return rows.groupBy("x.kind", "x.token").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("soft"), F.round(F.avg("label"), 9).alias("hard"))


def soft_calibration(spark: SparkSession, d: str) -> DataFrame:
    return diff.calibration_curve(_soft(spark, d).filter(F.col("n") >= 5))


def calibration_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _soft(spark, d).filter(F.col("n") >= 5).agg(F.round(F.corr("soft", "hard"), 6).alias("corr"))


def vocab_extension(spark: SparkSession, d: str) -> DataFrame:
    vocab = noise_vocab(spark, d)
    soft = _soft(spark, d).filter(F.col("n") >= 5)
    return diff.extend_vocabulary(vocab, soft, diff.calibration_curve(soft))


def _extra(spark: SparkSession, d: str, clean: bool = False) -> DataFrame:
    """Labelled edges with the extra words of all four kinds (V1); ``clean`` folds the number sign of addresses."""
    n = evenly(_named(spark, d))
    if clean:
        n = n.withColumns({c: squeeze(clean_addr(F.col(c))) for c in ("d1", "do")})
    n = diff.extra_by_kind(n).withColumn("fold", fold(F.col("s1"), StageParams.fold_seed, 2))
    return n.withColumn("label", F.when(F.arrays_overlap(words(F.col("m1")), words(F.col("mo"))), 1).otherwise(0).cast("bigint"))


def _extra_soft(x: DataFrame) -> DataFrame:
    rows = x.select("p", "label", F.explode(diff.kinded(diff.KINDS)).alias("x"))
    soft = rows.groupBy("x.kind", "x.token").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("soft"), F.round(F.avg("label"), 9).alias("hard"))
    return soft.filter(F.col("n") >= 5)


def diff_vocab(spark: SparkSession, d: str) -> DataFrame:
    """V4 in its four kinds."""
    return diff.noise_vocabulary(diff.token_counts(_extra(spark, d), diff.KINDS))


def diff_vocab_crossfit(spark: SparkSession, d: str) -> DataFrame:
    return diff.crossfit_scores(materialize(_extra(spark, d), "extra"), diff.KINDS)


def diff_features(spark: SparkSession, d: str) -> DataFrame:
    """V6: the 16 features, scored out of fold."""
    x = materialize(_extra(spark, d, clean=True), "extra")
    return diff.pair_features(x, diff.crossfit_scores(x, diff.KINDS, learn_from=_extra(spark, d)))


def diff_calibration(spark: SparkSession, d: str) -> DataFrame:
    return diff.calibration_curve(_extra_soft(_extra(spark, d)))


def diff_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _extra_soft(_extra(spark, d)).agg(F.round(F.corr("soft", "hard"), 6).alias("corr"))


def diff_vocab_extension(spark: SparkSession, d: str) -> DataFrame:
    x = materialize(_extra(spark, d), "extra")
    soft = _extra_soft(x)
    return diff.extend_vocabulary(diff.noise_vocabulary(diff.token_counts(x, diff.KINDS)), soft, diff.calibration_curve(soft))


def rank_topk_edges(spark: SparkSession, d: str) -> DataFrame:
    """S3: the four best S1 of every O and the eighteen best O of every S1, in one table of two ranks."""
    e = ranks.ranked(edges(spark, d), "o", [F.desc("p"), F.asc("s1")], "r_o")
    e = ranks.ranked(e, "s1", [F.desc("p"), F.asc("o")], "r_1")
    return e.filter("r_o <= 4 or r_1 <= 18").select("s1", "o", "r_o", "r_1")


def semi_anti_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records with a candidate, and records without one."""
    recs = records(spark, d).filter("side = 0").select("id")
    seen = edges(spark, d).select(F.col("o").alias("id"))
    some = recs.join(seen, "id", "left_semi").withColumn("has", F.lit("yes"))
    return some.unionByName(recs.join(seen, "id", "left_anti").withColumn("has", F.lit("no")))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """One S1 record in ten, by a portable hash: the same in every run and layout."""
    return _ids(spark, d).filter(fold(F.col("s1"), 3, 10) == 0)


def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2 and M5: pairs scored out of fold by boosted trees on set, number and rank features."""
    n = _labelled(spark, d)
    cols = features.overlap(F.col("d1"), F.col("do"), "ad") | features.number_features(F.col("m1"), F.col("mo")) | features.flags(F.col("c1"), F.col("co"), F.col("do"), F.col("o"))
    x = n.select("s1", "o", "p", "label", *[c.alias(a) for a, c in cols.items()]).withColumnRenamed("p", "blocking")
    x = materialize(x, "training")
    names = [c for c in x.columns if c not in ("s1", "o", "label")]
    return models.out_of_fold(x, names).select("s1", "o", "p")


def coverage_features(spark: SparkSession, d: str) -> DataFrame:
    """All ten."""
    recs = records(spark, d, hub=True)
    weights = [features.token_weights(recs, c, features.document_frequencies(recs, c)) for c in ("n_core", "a_norm")]
    return features.coverages(edges(spark, d), *weights)


def sim_token_set(spark: SparkSession, d: str) -> DataFrame:
    return evenly(_named(spark, d)).select("s1", "o", F.round(k.pairwise(k.token_set_ratio)(F.col("c1"), F.col("co")), 6).alias("nm_tset"))


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2: distinct records of each country and side."""
    return records(spark, d).groupBy("country", "side").agg(F.count_distinct("id").alias("n_ids"))


def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that occur on either side of a pair."""
    e = edges(spark, d)
    return e.select(F.col("s1").alias("id")).unionByName(e.select(F.col("o").alias("id"))).distinct()


def pair_index(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the row numbers of their ids in the exported index."""
    index = materialize(ranks.numbered(pair_ids(spark, d), ["id"]), "index")
    a, b = index.select(F.col("id").alias("s1"), F.col("row").alias("a")), index.select(F.col("id").alias("o"), F.col("row").alias("b"))
    return edges(spark, d).select("s1", "o").join(a, "s1").join(b, "o").select("s1", "o", "a", "b")


def first_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Five hundred S1 records in an order drawn by a portable hash; the number is what is asked for."""
    return _ids(spark, d).orderBy(F.md5(F.concat("s1", F.lit("|29"))), "s1").limit(500)


def attached(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the names of their records, '' where there is no such record (those of the hub are left out here)."""
    return features.attach(edges(spark, d).select("s1", "o"), records(spark, d), {"n_core": "c"}, "left")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """J8."""
    return metrics.labelled(edges(spark, d).select("s1", "o"), _truth(spark, d))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """S4."""
    return metrics.best_threshold(threshold_sweep(spark, d))


def path_scan(spark: SparkSession, d: str) -> DataFrame:
    """IO5: a table named by its path inside SQL."""
    return spark.sql(f"select country, count(*) as n from parquet.`{d}/s1.parquet` group by country")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """X1 to X14 of the candidates that blocking finds."""
    recs = materialize(records(spark, d), "records")
    return features.feature_table(materialize(blocking_candidates(recs), "candidates"), recs)


def linkage(spark: SparkSession, d: str) -> DataFrame:
    """The whole path: normalised records, blocking, stage 1 on all features, stage 2 on group and difference features, a blend of both
    scores; the best threshold of each by macro F0.5 against the pairs of equal words: (stage, threshold, macro_f05).

    All scores are out of fold. The blend's second scorer is the first stage, as the external one is an interface only.
    """
    recs = materialize(records(spark, d), "records")
    true, ids = pseudo_truth(recs), _ids(spark, d)
    table_ = metrics.labelled(features.feature_table(materialize(blocking_candidates(recs), "candidates"), recs), true)
    table_ = materialize(table_, "features")
    names = [c for c in table_.columns if c not in ("s1", "o", "label")]
    first = materialize(models.out_of_fold(table_, names).select("s1", "o", "label", "p"), "stage-1")
    kept = group.plausible(first)
    sides = features.attach(kept, recs, {"n_core": "c", "a_norm": "d", "a_nums": "m"})
    x = diff.extra_by_kind(evenly(sides)).withColumn("fold", fold(F.col("s1"), StageParams.fold_seed, 2))
    x = materialize(x, "extra")
    differs = diff.pair_features(x, diff.crossfit_scores(x, diff.KINDS))
    others = recs.filter("side = 0")
    around = group.competition(kept.select("s1", "o", "p")).join(group.siblings(kept, others.select(F.col("id").alias("o"), "n_core", "a_norm")), ["s1", "o"])
    around = around.join(group.twins(recs).withColumnRenamed("id", "o"), "o").withColumn("logit_p", group.logit(F.col("p")))
    second = materialize(models.stage_two(kept, around, differs), "stage-2")
    scored = second.join(first.select("s1", "o", group.logit(F.col("p")).alias("ce")), ["s1", "o"])
    blended = models.blend(metrics.labelled(group.blend_features(scored), true), group.BLEND, StageParams.blend_seed)
    best = [metrics.best_threshold(metrics.sweep(s, true, ids)).withColumn("stage", F.lit(n)) for n, s in (("1", first), ("2", second), ("blend", blended))]
    return best[0].unionByName(best[1]).unionByName(best[2])


QUERIES = {
    f.__name__: f
    for f in (
        competition, logit_p, twins, siblings, blend_features, one_owner, expected_f_decision, id_lists, candidate_lists, macro_f05, threshold_sweep,
        holdout_split, pair_texts, token_overlap, number_features, pair_flags, idf_tokens, fuzzy_coverage, sim_ratio, sim_token_sort, sim_jaro_winkler,
        sim_levenshtein, similarities, number_relation, extra_words, edit_codes, noise_vocab, noise_vocab_crossfit, word_features, soft_calibration,
        calibration_correlation, vocab_extension, rank_topk_edges, semi_anti_ids, hash_sample, gbt_scores, coverage_features, sim_token_set, record_counts, pair_ids, pair_index,
        first_by_hash, attached, labels, best_threshold, path_scan,
    )
}
# those that read names or addresses, over the normalisers, which SQL does not state
QUERIES |= {
    f"normed_{f.__name__}": normed(f)
    for f in (
        twins, siblings, macro_f05, threshold_sweep, pair_texts, token_overlap, number_features, pair_flags, idf_tokens, fuzzy_coverage, sim_ratio,
        sim_token_sort, sim_jaro_winkler, sim_levenshtein, similarities, number_relation, extra_words, edit_codes, gbt_scores,
    )
}
# V4 to V8 as the survey lists them; noise_vocab and those after it are the part that SQL states in good time
QUERIES |= {f.__name__: normed(f) for f in (feature_table, linkage, diff_vocab, diff_vocab_crossfit, diff_features, diff_calibration, diff_correlation, diff_vocab_extension)}

_E = "ed as (select s1, o, round(greatest(0, s / (abs(s) + 20)), 6) as p from (select s1, o, max(bscore) as s from cand where bscore is not null and not isnan(bscore) and s1 is not null and o is not null group by s1, o))"
_N = f"""{_E},
{REC_HUB},
nm as (select ed.s1, ed.o, ed.p, a.n_core as c1, b.n_core as co, a.a_norm as d1, b.a_norm as do_, a.a_nums as m1, b.a_nums as mo
  from ed join rec a on a.side = 1 and a.id = ed.s1 join rec b on b.side = 0 and b.id = ed.o)"""
_TR = """
l as (select country, n_core, a_norm, min(id) as s1 from rec where side = 1 and n_core <> '' and a_norm <> '' group by all),
tr as (select distinct l.s1, r.id as o from l join rec r on r.side = 0 and r.country = l.country and r.n_core = l.n_core and r.a_norm = l.a_norm)"""
_OWN = "ow as (select s1, o, p from (select *, row_number() over (partition by o order by p desc, s1) as k from ed) where k = 1)"


def _tok(col: str) -> str:
    return f"list_filter(string_split({col}, ' '), lambda w: w <> '')"


def _set(col: str) -> str:
    return f"list_distinct({_tok(col)})"


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence of two strings, row by row; indices and letters as one-element lists."""
    row = f"""list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [cast(j as bigint)]), lambda acc, j: list_append(acc,
      case when unicode(substr({b}, j[1], 1)) = c[1] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], acc[j[1]]) end), [cast(0 as bigint)])"""
    return f"""(case when {a} = '' or {b} = '' then 0 else list_reduce(list_transform(string_split({a}, ''), lambda c: [cast(unicode(c) as bigint)]),
      lambda prev, c: {row}, list_transform(range(length({b}) + 1), lambda x: cast(0 as bigint)))[length({b}) + 1] end)"""


def _ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100.0 else 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) end)"


def _set_ratio(a: str, b: str) -> str:
    """The token set ratio of two lists of distinct tokens: 100 if one holds the other, else the best of the ratios of the common part
    with each rest added, and of the common part with either."""
    text = lambda x: f"array_to_string(list_sort({x}), ' ')"
    both = text(f"list_filter({a}, lambda w: list_contains({b}, w))")
    ra, rb = text(f"list_filter({a}, lambda w: not list_contains({b}, w))"), text(f"list_filter({b}, lambda w: not list_contains({a}, w))")
    head = f"(case when {both} = '' then 0 else length({both}) + 1 end)"
    la, lb = f"(length({ra}) + {head})", f"(length({rb}) + {head})"
    return f"""round(case when length({a}) = 0 or length({b}) = 0 then 0.0 when {both} <> '' and ({ra} = '' or {rb} = '') then 100.0
      else greatest(200.0 * ({head} + {_lcs(ra, rb)}) / ({la} + {lb}), case when {both} = '' then 0.0 else greatest(200.0 * length({both}) / (length({both}) + {la}), 200.0 * length({both}) / (length({both}) + {lb})) end) end, 6)"""


def _mean6(x: str) -> str:
    return f"floor((2 * sum(cast(round({x} * 1000000) as bigint)) + count({x})) / (2 * count({x}))) / 1000000"


def _overlap(stem: str, a: str, b: str) -> str:
    x, y = _set(a), _set(b)
    both = f"length(list_intersect({x}, {y}))"
    some = f"length({x}) > 0 and length({y}) > 0"
    return f"""case when {some} then round({both} / (length({x}) + length({y}) - {both}), 6) end as {stem}_jac,
case when {some} then round({both} / length({x}), 6) end as {stem}_cont1, case when {some} then round({both} / length({y}), 6) end as {stem}_conto"""


_GRIDSQL = ", ".join(f"({x})" for x in GRID)
_XW = f"""{_N},
xl as (select s1, o, p, {_set("c1")} as a, {_set("co")} as b, {_tok("m1")} as na, {_tok("mo")} as nb from nm),
px as (select s1, o, p, case when list_has_any(na, nb) then 1 else 0 end as label, {fold_sql("s1", StageParams.fold_seed, 2)} as fold,
  list_filter(b, lambda t: not list_contains(a, t)) as nx, list_filter(a, lambda t: not list_contains(b, t)) as nd from xl),
tk as (select s1, o, p, label, fold, 'n_core' as kind, unnest(nx) as token from px union all select s1, o, p, label, fold, 'n_core_d', unnest(nd) from px)"""
_V = VocabParams()
_VOC = f"{_XW}, vo as (select kind, token, round((sum(label) + {_V.prior * _V.weight}) / (count(*) + {_V.weight}), 6) as score from tk group by kind, token having count(*) >= {_V.least_pairs})"
_CF = f"""{_XW}, lv as (select 1 - fold as fold, kind, token, round((sum(label) + {_V.prior * _V.weight}) / (count(*) + {_V.weight}), 6) as score from tk group by fold, kind, token having count(*) >= {_V.least_pairs}),
cf as (select tk.s1, tk.o, tk.kind, tk.token, coalesce(lv.score, {_V.prior}) as score from tk left join lv on lv.fold = tk.fold and lv.kind = tk.kind and lv.token = tk.token)"""
_SO = f"""{_VOC}, so as (select * from (select kind, token, count(*) as n, round(avg(p), 9) as soft, round(avg(label), 9) as hard from tk group by kind, token) where n >= 5),
bi as (select cast(least(floor(soft * {_V.bins}), {_V.bins - 1}) as bigint) as bin, count(*) as n, round(avg(soft), 9) as x, round(avg(hard), 9) as m from so group by 1 having count(*) >= {_V.least_in_bin}),
cu as (select bin, n, x, max(m) over (order by bin rows between unbounded preceding and current row) as y from bi)"""
_F1, _FO = "string_split(m1, ' ')[1]", "string_split(mo, ' ')[1]"
SQL = {
    "competition": f"""with {_E}, a as (select *, row_number() over (partition by o order by p desc, s1) as o_rank from ed where p >= 0.01),
b as (select *, max(p) over (partition by o) as o_best, count(*) filter (where p >= 0.2) over (partition by o) as o_n_plaus,
  coalesce(max(case when o_rank = 2 then p end) over (partition by o), 0) as o_second, count(*) filter (where p >= 0.5) over (partition by s1) as s1_n_conf,
  round(sum(p) over (partition by s1), 6) as s1_sum_p, max(p) over (partition by s1) as s1_max_p from a),
c as (select *, case when o_rank = 1 then o_second else o_best end as o_best_other from b) select *, round(p - o_best_other, 6) as o_margin from c""",
    "logit_p": f"with {_E} select s1, o, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) as logit_p from ed",
    "twins": f"""with {REC_HUB.replace(" union all select entity_id, business_name, business_address, country from o_hub", "")}
select id, count(*) over (partition by n_core) - 1 as twin_name, count(*) over (partition by n_core, string_split(a_nums, ' ')[1]) - 1 as twin_key from rec where side = 0""",
    "blend_features": f"""with {_E}, s as (select *, round(p * 10 - 5, 6) as ce from ed),
o as (select o, max(ce) as ce_o_max, count(*) as ce_o_n, max(p) as pm, list_sort(list(ce), 'desc') as all_ce from s group by o),
t as (select s1, max(ce) as ce_s1_max, {_mean6('ce')} as ce_s1_mean from s group by s1)
select s1, o, p, ce, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) as lp, ce_o_max, ce_o_n, round(ce - ce_o_max, 6) as ce_gap_o,
  round(p - pm, 6) as p_gap_o, coalesce(all_ce[2], -20) as ce_o_second, ce_s1_max, ce_s1_mean, round(ce - ce_s1_max, 6) as ce_gap_s1 from s join o using (o) join t using (s1)""",
    "siblings": f"""with {_E}, {REC_HUB}, kp as (select * from ed where p >= 0.01),
x as (select a.s1, a.o, b.o as o2, b.p as p2 from kp a join kp b on a.s1 = b.s1 and b.p >= 0.3 and a.o <> b.o),
w as (select x.*, array_to_string(list_sort({_tok("r.n_core")}), ' ') as na, array_to_string(list_sort({_tok("q.n_core")}), ' ') as nb, {_set("r.a_norm")} as aa, {_set("q.a_norm")} as ab
  from x join rec r on r.side = 0 and r.id = x.o join rec q on q.side = 0 and q.id = x.o2),
nr as (select na, nb, round({_ratio("na", "nb")}, 6) as nm from (select distinct na, nb from w)),
ar as (select aa, ab, {_set_ratio("aa", "ab")} as ad from (select distinct aa, ab from w)),
y as (select w.*, nm, ad, least(nm, ad) as sb from w join nr using (na, nb) join ar using (aa, ab)),
g as (select s1, o, count(*) as n, max(nm) as a1, max(ad) as a2, max(sb) as a3, {_mean6('nm')} as a4, count(*) filter (where nm >= 90 and ad >= 80) as c,
  max(case when nm >= 90 and ad >= 80 then p2 else 0 end) as cp, round(sum(sb * p2) / sum(p2), 6) as ws from y group by s1, o)
select kp.s1, kp.o, coalesce(n, 0) as sib_n, a1 as sib_nm_max, a2 as sib_ad_max, a3 as sib_both_max, a4 as sib_nm_mean, coalesce(c, 0) as sib_close, cp as sib_close_p, ws as sib_wsim
from kp left join g on g.s1 = kp.s1 and g.o = kp.o""",
    "sim_token_set": f"""with {_N}, x as (select s1, o, {_set("c1")} as a, {_set("co")} as b from nm),
y as (select a, b, {_set_ratio("a", "b")} as r from (select distinct a, b from x)) select s1, o, r as nm_tset from x join y using (a, b)""",
    "record_counts": f"""with {REC_HUB.replace(" union all select entity_id, business_name, business_address, country from o_hub", "")}
select country, side, count(distinct id) as n_ids from rec group by country, side""",
    "pair_ids": f"with {_E} select s1 as id from ed union select o from ed",
    "pair_index": f"""with {_E}, ix as (select id, row_number() over (order by id) - 1 as row from (select s1 as id from ed union select o from ed))
select ed.s1, ed.o, x.row as a, y.row as b from ed join ix x on x.id = ed.s1 join ix y on y.id = ed.o""",
    "first_by_hash": "select entity_id as s1 from s1 order by md5(entity_id || '|29'), entity_id limit 500",
    "attached": f"""with {_E}, {REC_HUB.replace(" union all select entity_id, business_name, business_address, country from o_hub", "")}
select ed.s1, ed.o, coalesce(a.n_core, '') as c1, coalesce(b.n_core, '') as co from ed left join rec a on a.side = 1 and a.id = ed.s1 left join rec b on b.side = 0 and b.id = ed.o""",
    "labels": f"""with {_E}, {REC_HUB}, {_TR} select s1, o, cast(case when exists (select 1 from tr where tr.s1 = ed.s1 and tr.o = ed.o) then 1 else 0 end as bigint) as label from ed""",
    "path_scan": "select country, count(*) as n from s1 group by country",
    "one_owner": f"with {_E}, {_OWN} select s1, o, p from ow where p >= 0.5",
    "expected_f_decision": f"""with {_E}, {_OWN}, kp as (select * from ow where p >= 0.2),
r as (select *, row_number() over w as k, sum(p) over (w rows between unbounded preceding and current row) as top, sum(p) over (partition by s1) as total,
  exp(sum(ln(greatest(1 - p, 1e-12))) over (partition by s1)) as none from kp window w as (partition by s1 order by p desc, o)),
v as (select *, round(1.25 * top / (0.25 * (total + 0.1) + k), 9) as val from r), b as (select *, max(val) over (partition by s1) as best from v),
c as (select *, min(case when val = best then k end) over (partition by s1) as cut from b) select s1, o from c where k <= cut and best > round(none, 9)""",
    "id_lists": f"""with {_E}, {_OWN}, g as (select s1, string_agg(distinct o, ',' order by o) as l from ow where p >= 0.5 group by s1)
select s1.entity_id as source1_entity_id, coalesce(g.l, '') as matched_entity_ids from s1 left join g on g.s1 = s1.entity_id""",
    "candidate_lists": f"""with {_E}, g as (select s1, string_agg(distinct o, ',' order by o) as l from ed group by s1)
select s1.entity_id as source1_entity_id, coalesce(g.l, '') as candidate_entity_ids from s1 left join g on g.s1 = s1.entity_id""",
    "macro_f05": f"""with {_E}, {REC_HUB}, {_TR}, {_OWN}, pd as (select s1, o from ow where p >= 0.5),
x as (select i.entity_id, (select count(*) from pd where pd.s1 = i.entity_id) as np, (select count(*) from tr where tr.s1 = i.entity_id) as nt,
  (select count(*) from pd join tr on pd.s1 = tr.s1 and pd.o = tr.o where pd.s1 = i.entity_id) as tp from s1 i)
select count(*) as n, round(avg(case when nt = 0 and np = 0 then 1 when tp = 0 then 0 else 1.25 * tp / (0.25 * nt + np) end), 6) as macro_f05 from x""",
    "threshold_sweep": f"""with {_E}, {REC_HUB}, {_TR}, {_OWN}, g(threshold) as (values {_GRIDSQL}),
nt as (select s1, count(*) as nt from tr group by s1), h as (select ow.*, case when tr.o is not null then 1 else 0 end as t from ow left join tr on tr.s1 = ow.s1 and tr.o = ow.o),
pr as (select g.threshold, h.s1, count(*) as np, sum(t) as tp from g join h on h.p >= cast(g.threshold as double) group by all),
a as (select g.threshold, i.entity_id, coalesce(nt.nt, 0) as nt, coalesce(pr.np, 0) as np, coalesce(pr.tp, 0) as tp from g cross join s1 i
  left join nt on nt.s1 = i.entity_id left join pr on pr.s1 = i.entity_id and pr.threshold = g.threshold)
select cast(threshold as double) as threshold, round(avg(case when nt = 0 and np = 0 then 1 when tp = 0 then 0 else 1.25 * tp / (0.25 * nt + np) end), 6) as macro_f05 from a group by 1""",
    "best_threshold": "",
    "holdout_split": f"""with {_E}, h as (select s1, o, {fold_sql("s1", StageParams.holdout_seed, 100)} < {StageParams.holdout_percent} as h from ed)
select s1, o, case when o in (select o from h where h) then 'hold' else 'train' end as part from h""",
    "pair_texts": f"with {_N} select s1, o, c1 || ' | ' || d1 as a, co || ' | ' || do_ as b from nm",
    "token_overlap": f"with {_N} select s1, o, {_overlap('nm', 'c1', 'co')}, {_overlap('ad', 'd1', 'do_')} from nm",
    "number_features": f"""with {_N}, x as (select s1, o, {_tok("m1")} as a, {_tok("mo")} as b, {_set("m1")} as da, {_set("mo")} as db from nm)
select s1, o, case when length(a) > 0 and length(b) > 0 then case when a[1] = b[1] then 1.0 when list_contains(b, a[1]) then 0.5 else 0.0 end end as num_first,
case when length(a) > 0 and length(b) > 0 then round(length(list_intersect(da, db)) / (length(da) + length(db) - length(list_intersect(da, db))), 6) end as num_jac,
case when length(a) > 0 and length(b) > 0 then round(length(list_intersect(da, db)) / length(da), 6) end as num_cont1 from x""",
    "pair_flags": f"""with {_N} select s1, o, cast(length({_tok("c1")}) as bigint) as len_core_1, cast(length({_tok("co")}) as bigint) as len_core_o,
cast(case when do_ = '' then 1 else 0 end as bigint) as addr_empty_o, cast(case when starts_with(o, 'S3') then 1 else 0 end as bigint) as src3 from nm""",
    "idf_tokens": f"""with {REC_HUB.replace(" union all select entity_id, business_name, business_address, country from o_hub", "")},
t as (select id, unnest({_set("n_core")}) as token from rec) select token, count(*) as df, round(ln(1 + (select count(*) from rec) / count(*)), 6) as idf from t group by token""",
    "fuzzy_coverage": f"""with {_N}, tt as (select id, unnest({_set("n_core")}) as token from rec),
df as (select token, round(ln(1 + (select count(*) from rec) / count(*)), 6) as idf from tt group by token),
a as (select s1, o, {_tok("c1")} as ta, {_tok("co")} as tb from nm where c1 <> '' and co <> ''),
u as (select s1, o, tb, unnest(ta) as t, unnest(range(1, length(ta) + 1)) as i from a),
pt as (select distinct x.t, y.w from (select distinct t, unnest(tb) as w from u) y join (select distinct t from u) x on x.t = y.t where length(x.t) >= 4 and length(y.w) >= 1 and 200 * least(length(x.t), length(y.w)) >= 85 * (length(x.t) + length(y.w))),
nr as (select t, w from pt where 200 * {_lcs("t", "w")} >= 85 * (length(t) + length(w))),
nl as (select t, list(w) as ws from nr group by t),
f as (select u.s1, u.o, u.i, df.idf, list_contains(u.tb, u.t) as ex, list_contains(u.tb, u.t) or coalesce(list_has_any(nl.ws, u.tb), false) as hit from u join df on df.token = u.t left join nl on nl.t = u.t),
g as (select s1, o, round(sum(case when hit then 1 else 0 end) / count(*), 6) as fcov, round(sum(case when hit then idf else 0 end) / sum(idf), 6) as wcov,
round(sum(case when ex then idf else 0 end) / sum(idf), 6) as wexact from f group by s1, o) select ed.s1, ed.o, fcov, wcov, wexact from ed left join g on g.s1 = ed.s1 and g.o = ed.o""",
    "sim_ratio": f"with {_N} select s1, o, round({_ratio('c1', 'co')}, 6) as nm_ratio from nm",
    "sim_token_sort": f"""with {_N}, x as (select s1, o, array_to_string(list_sort({_tok("c1")}), ' ') as a, array_to_string(list_sort({_tok("co")}), ' ') as b from nm)
select s1, o, round({_ratio("a", "b")}, 6) as nm_tsort from x""",
    "sim_jaro_winkler": f"with {_N} select s1, o, round(jaro_winkler_similarity(c1, co), 6) as nm_jw from nm",
    "sim_levenshtein": f"with {_N} select s1, o, levenshtein(c1, co) as edits from nm",
    "number_relation": f"""with {_N}, x as (select s1, o, {_F1} as a, {_FO} as b from nm),
y as (select *, list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) as df from x)
select s1, o, cast(case when a = '' or b = '' then 1 when a = b then 0 when ends_with(a, b) then 2 when starts_with(a, b) then 3 when ends_with(b, a) then 4 when starts_with(b, a) then 5
when length(a) <> length(b) then 10 when length(df) > 1 then 9 when df[1] = 1 then 6 when df[1] = length(a) then 8 else 7 end as bigint) as num_rel from y""",
    "extra_words": f"""with {_N}, a as (select s1, o, {_set("c1")} as ta, {_set("co")} as tb from nm),
pt as (select distinct least(x, y) as t, greatest(x, y) as w from (select unnest(ta) as x, tb from a) join lateral (select unnest(tb) as y) on true where x <> y and length(x) + length(y) >= 5
  and 200 * least(length(x), length(y)) >= 85 * (length(x) + length(y))),
nr as (select t, w from pt where 200 * {_lcs("t", "w")} >= 85 * (length(t) + length(w))),
nl as (select t, list(w) as ws from (select t, w from nr union all select w, t from nr) group by t),
xs as (select s1, o, string_agg(t, ' ' order by t) as v from (select s1, o, ta, unnest(tb) as t from a) q left join nl using (t)
  where not list_contains(ta, t) and not (length(t) >= 4 and coalesce(list_has_any(ws, ta), false)) group by s1, o),
ds as (select s1, o, string_agg(t, ' ' order by t) as v from (select s1, o, tb, unnest(ta) as t from a) q left join nl using (t)
  where not list_contains(tb, t) and not (length(t) >= 4 and coalesce(list_has_any(ws, tb), false)) group by s1, o)
select a.s1, a.o, coalesce(xs.v, '') as x_words, coalesce(ds.v, '') as d_words from a left join xs on xs.s1 = a.s1 and xs.o = a.o left join ds on ds.s1 = a.s1 and ds.o = a.o""",
    "noise_vocab": f"with {_VOC} select kind, token, score from vo",
    "noise_vocab_crossfit": f"with {_CF} select s1, o, kind, token, score from cf",
    "word_features": f"with {_CF} select s1, o, kind, count(*) as x_n, min(score) as x_min, round(avg(score), 9) as x_mean from cf group by s1, o, kind",
    "soft_calibration": f"with {_SO} select bin, n, x, y from cu",
    "calibration_correlation": f"with {_SO} select round(corr(soft, hard), 6) as corr from so",
    "vocab_extension": f"""with {_SO}, sg as (select x as x0, y as y0, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from cu),
nw as (select so.kind, so.token, soft from so where not exists (select 1 from vo where vo.kind = so.kind and vo.token = so.token))
select kind, token, score from vo union all
select kind, token, round(case when soft <= (select min(x) from cu) then (select arg_min(y, x) from cu) when soft > (select max(x) from cu) then (select arg_max(y, x) from cu)
  else (select y0 + (soft - x0) * (y1 - y0) / (x1 - x0) from sg where x1 is not null and soft > x0 and soft <= x1 limit 1) end, 6) as score from nw""",
    "rank_topk_edges": f"""with {_E}, r as (select s1, o, row_number() over (partition by o order by p desc, s1) as r_o, row_number() over (partition by s1 order by p desc, o) as r_1 from ed)
select s1, o, r_o, r_1 from r where r_o <= 4 or r_1 <= 18""",
    "semi_anti_ids": f"""with {_E}, {REC_HUB.replace(" union all select entity_id, business_name, business_address, country from o_hub", "")}
select id, case when id in (select o from ed) then 'yes' else 'no' end as has from rec where side = 0""",
    "hash_sample": f"select entity_id as s1 from s1 where {fold_sql('entity_id', 3, 10)} = 0",
}
SQL["best_threshold"] = f"with sw as ({SQL['threshold_sweep']}) select threshold, macro_f05 from sw order by macro_f05 desc, threshold limit 1"
