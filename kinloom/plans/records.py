"""The test tables as linkage records, with names and addresses normalised by plain rules that SQL can state too, or,
inside ``normed``, by the normalisers of ``functions.text``."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.text import norm_record, words
from kinloom.session import evenly

_NORMED: ContextVar[bool] = ContextVar("normed", default=False)


def normed(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query over records as ``norm_record`` gives them, alternative names included."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        before = _NORMED.set(True)
        try:
            return query(spark, d)
        finally:
            _NORMED.reset(before)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(col: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), "[^a-z0-9]+", " "))


def others(spark: SparkSession, sf_dir: str, hub: bool = False) -> DataFrame:
    cols = ["entity_id", "business_name", "business_address", "country"]
    out = table(spark, sf_dir, "s2").select(cols).unionByName(table(spark, sf_dir, "s3").select(cols))
    if hub:
        out = out.unionByName(table(spark, sf_dir, "o_hub").select(cols))
    return out.dropDuplicates(["entity_id"])


def records(spark: SparkSession, sf_dir: str, hub: bool = False) -> DataFrame:
    """(id, country, side, n_core, n_alt, a_norm, a_nums) of both sides."""
    left = table(spark, sf_dir, "s1").select("entity_id", "business_name", "business_address", "country").withColumn("side", F.lit(1))
    both = left.unionByName(others(spark, sf_dir, hub).withColumn("side", F.lit(0)))
    if _NORMED.get():
        full = norm_record(evenly(both), "business_name", "business_address")
        return full.select(F.col("entity_id").alias("id"), "country", "side", "n_full", "n_core", "n_alt", "n_legal", "n_dom", "a_norm", "a_nums", "a_state")
    named = both.select(F.col("entity_id").alias("id"), "country", "side", plain("business_name").alias("n_core"), F.lit("").alias("n_alt"), plain("business_address").alias("a_norm"))
    return named.withColumn("a_nums", F.array_join(F.filter(words(F.col("a_norm")), lambda w: w.rlike("^[0-9]+$")), " "))


def _rec(hub: bool) -> str:
    more = " union all select entity_id, business_name, business_address, country from o_hub" if hub else ""
    return f"""
src as (select entity_id, business_name, business_address, country, 1 as side from s1
  union all select any_value(entity_id), any_value(business_name), any_value(business_address), any_value(country), 0 as side
  from (select entity_id, business_name, business_address, country from s2 union all select entity_id, business_name, business_address, country from s3{more}) group by entity_id),
rec0 as (select entity_id as id, country, side, trim(regexp_replace(lower(coalesce(business_name, '')), '[^a-z0-9]+', ' ', 'g')) as n_core,
  trim(regexp_replace(lower(coalesce(business_address, '')), '[^a-z0-9]+', ' ', 'g')) as a_norm from src),
rec as (select *, array_to_string(list_filter(string_split(a_norm, ' '), lambda w: regexp_full_match(w, '[0-9]+')), ' ') as a_nums from rec0)"""


REC = _rec(False)
REC_HUB = _rec(True)
