"""Queries of candidate generation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import blocking as b
from kinloom.plans.records import REC, normed, records


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return b.block_keys(records(spark, d))


def block_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("id", "country", "key")


def key_stats(spark: SparkSession, d: str) -> DataFrame:
    return b.key_stats(_keys(spark, d))


def _rare(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d)
    return b.rare_keys(keys, b.key_stats(keys))


def rare_keys(spark: SparkSession, d: str) -> DataFrame:
    return _rare(spark, d).select("id", "country", "key", "typ", "rn")


def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    return b.composite_keys(_rare(spark, d)).select("id", "country", "ck")


def composite_weights(spark: SparkSession, d: str) -> DataFrame:
    return b.composite_weights(b.composite_keys(_rare(spark, d))).withColumn("w", F.round("w", 6))


def pair_estimate(spark: SparkSession, d: str) -> DataFrame:
    return b.pair_estimate(b.composite_weights(b.composite_keys(_rare(spark, d))))


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return b.scored(records(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return b.candidates(records(spark, d))


def pseudo_truth(recs: DataFrame) -> DataFrame:
    """(s1, o): the least S1 record with the same words in name and address, both non-empty."""
    full = recs.filter("n_core <> '' and a_norm <> ''")
    left = full.filter("side = 1").groupBy("country", "n_core", "a_norm").agg(F.min("id").alias("s1"))
    return left.join(full.filter("side = 0"), ["country", "n_core", "a_norm"]).select("s1", F.col("id").alias("o"))


def blocking_recall(spark: SparkSession, d: str) -> DataFrame:
    recs = records(spark, d)
    return b.blocking_recall(pseudo_truth(recs), b.candidates(recs), recs)


def owners(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the S1 owner of every other record, by blocking score, with the owner's id list."""
    best = candidates(spark, d).filter("r_o = 1")
    return best.select("s1", "o", "bscore")


QUERIES = {f.__name__: f for f in (block_keys, key_stats, rare_keys, composite_keys, composite_weights, pair_estimate, pair_scores, candidates, blocking_recall, owners)}
# the same over the normalisers, which SQL does not state
QUERIES |= {f"normed_{name}": normed(f) for name, f in QUERIES.items()}

# The SQL works on lists: a record's keys are one list, its rarest keys are slices of sorted lists, its composite keys a list of pairs of
# them, and a composite's pairs of records the product of its two lists of ids.
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_NUMBER = "regexp_full_match(w, '[0-9]+')"
_K = f"""{REC},
tokens as (select id, side, country, {_WORDS.format("n_core")} as nw, {_WORDS.format("a_norm")} as aw, replace(n_core, ' ', '') as run from rec),
lists as (select id, side, country, list_distinct(flatten([
  list_transform(list_filter(nw, lambda w: length(w) >= 2), lambda w: 'W:' || w),
  list_transform(list_filter(nw, lambda w: length(w) >= 7), lambda w: 'P:' || w[1:5]),
  list_filter(['C:' || run], lambda x: length(run) >= 5),
  list_transform(list_filter(range(1, length(run) - 2), lambda i: length(run) >= 6), lambda i: 'G:' || substr(run, i, 4)),
  list_transform(list_filter(aw, lambda w: not {_NUMBER} and (length(w) >= 3 or regexp_matches(w, '[0-9]'))), lambda w: 'A:' || w),
  list_transform(list_filter(aw, lambda w: {_NUMBER} and length(w) >= 2), lambda w: 'N:' || w)])) as keys from tokens),
k as (select id, side, country, unnest(keys) as key from lists),
n_left as (select country, key, count(*) as df1 from k where side = 1 group by all), n_right as (select country, key, count(*) as dfo from k where side = 0 group by all),
st as (select * from n_left join n_right using (country, key))"""
_R = f"""{_K},
kind(letter, typ, left_n, right_n) as (values ('W', 'n', 3, 2), ('P', 'n', 3, 2), ('C', 'n', 3, 2), ('G', 'g', 6, 3), ('A', 'a', 7, 4), ('N', 'a', 7, 4)),
by_rarity as (select side, id, country, typ, list_sort(list({{'df1': df1, 'dfo': dfo, 'key': key}})) as l, any_value(case side when 1 then left_n else right_n end) as most
  from k join st using (country, key) join kind on kind.letter = key[1] group by side, id, country, typ),
rk as (select id, side, country, typ, l[rn].key as key, l[rn].df1 as df1, rn from (select *, unnest(range(1, least(most, length(l)) + 1)) as rn from by_rarity))"""
_C = f"""{_R},
held as (select id, side, country, case side when 1 then 5 else 4 end as both_a, list({{'key': key, 'typ': typ, 'rn': rn, 'df1': df1}}) as ks from rk group by all),
ck as (select id, side, country, unnest(list_distinct(list_concat(
  flatten(list_transform(ks, lambda x: list_transform(list_filter(ks, lambda y: x.key < y.key and (x.typ = 'g') = (y.typ = 'g') and (x.typ <> 'a' or y.typ <> 'a' or greatest(x.rn, y.rn) <= both_a)),
    lambda y: x.key || '|' || y.key))),
  list_transform(list_filter(ks, lambda x: x.df1 <= 3), lambda x: x.key)))) as ck from held)"""
_W = f"""{_C},
shared as (select country, ck, list(id) filter (where side = 1) as left_ids, list(id) filter (where side = 0) as right_ids from ck group by country, ck),
cw as (select country, ck, length(left_ids) as df1, length(right_ids) as dfo, ln(1 + 1e6 / length(right_ids)) as w, left_ids, right_ids from shared
  where length(left_ids) between 1 and 30 and length(right_ids) between 1 and 150)"""
_P = f"""{_W},
one as (select unnest(left_ids) as s1, right_ids, w from cw), two as (select s1, unnest(right_ids) as o, w from one),
pr as (select s1, o, round(sum(w), 6) as bscore, count(*) as nk from two group by s1, o)"""
_S = f"""{_P},
of_o as (select o, max(bscore) as mo, count(*) as n_o from pr group by o), of_1 as (select s1, max(bscore) as m1, count(*) as n_1 from pr group by s1),
top as (select * from pr qualify row_number() over (partition by o order by bscore desc, s1) <= 4 union select * from pr qualify row_number() over (partition by s1 order by bscore desc, o) <= 18),
sel as (select s1, o, bscore, nk, row_number() over (partition by o order by bscore desc, s1) as r_o, row_number() over (partition by s1 order by bscore desc, o) as r_1,
  round(bscore / mo, 6) as rel_o, round(bscore / m1, 6) as rel_1, n_o, n_1 from top join of_o using (o) join of_1 using (s1))"""
SQL = {
    "block_keys": f"with {_K} select id, country, key from k",
    "key_stats": f"with {_K} select country, key, df1, dfo from st",
    "rare_keys": f"with {_R} select id, country, key, typ, rn from rk",
    "composite_keys": f"with {_C} select id, country, ck from ck",
    "composite_weights": f"with {_W} select country, ck, df1, dfo, round(w, 6) as w from cw",
    "pair_estimate": f"with {_W} select country, cast(sum(df1 * dfo) as bigint) as raw_pairs from cw group by country",
    "pair_scores": f"with {_P} select s1, o, bscore, nk from pr",
    "candidates": f"with {_S} select s1, o, bscore, nk, r_o, r_1, rel_o, rel_1, n_o, n_1 from sel",
    "owners": f"with {_S} select s1, o, bscore from sel where r_o = 1",
    "blocking_recall": f"""with {_S},
l as (select country, n_core, a_norm, min(id) as s1 from rec where side = 1 and n_core <> '' and a_norm <> '' group by all),
tr as (select l.s1, r.id as o, r.country from l join rec r on r.side = 0 and r.country = l.country and r.n_core = l.n_core and r.a_norm = l.a_norm)
select tr.country, left(tr.o, 2) as source, count(*) as n_true, count(sel.o) as n_found, round(count(sel.o) / count(*), 6) as recall
from tr left join sel on sel.s1 = tr.s1 and sel.o = tr.o group by all""",
}
