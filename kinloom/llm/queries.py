"""The pN_ queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.forms import find_disguised
from kinloom.llm.labelmodel import link_entities
from kinloom.llm.language import wrong_labels
from kinloom.llm.leaks import find_leaks
from kinloom.llm.organisations import same_organisation
from kinloom.llm.packing import pack_documents
from kinloom.llm.premises import same_premises
from kinloom.llm.topn import top_n_per_group


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _others(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["entity_id", "business_name", "business_address", "country"]
    return _read(spark, sf_dir, "s2").select(cols).unionByName(_read(spark, sf_dir, "s3").select(cols))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_premises(_read(spark, sf_dir, "s1"), _others(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_organisation(_read(spark, sf_dir, "s1"), _others(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(_read(spark, sf_dir, "cand"), "o", "s1", "bscore", 4).select(F.col("i").alias("s1"), F.col("g").alias("o"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_disguised([_read(spark, sf_dir, t) for t in ("s1", "s2", "s3")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_entities(_read(spark, sf_dir, "s1"), _others(spark, sf_dir)).select("s1", "o")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(_read(spark, sf_dir, "documents")).select("doc_id", "true_lang").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p7_containers": p7_containers,
        "p8_found": p8_found,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return SQL


SQL = {
    "p3_found": """
with b as (select o, s1, max(bscore) as s from cand where bscore is not null and not isnan(bscore) and o is not null and s1 is not null group by o, s1),
r as (select o, s1, row_number() over (partition by o order by s desc, s1) as k from b)
select s1, o from r where k <= 4""",
}
