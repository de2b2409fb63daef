"""Queries of the general operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.skew import heavy_keys, tree_aggregate


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for table, column in (("cand", "o"), ("s1", "n_core")):
        part = heavy_keys(_table(spark, sf_dir, table), column).select(F.lit(f"{table}.{column}").alias("field_name"), "key_text")
        found = part if found is None else found.unionByName(part)
    return found


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, column in (("cand", "o"), ("s1", "n_core")):
        part = tree_aggregate(_table(spark, sf_dir, table), [column]).select(F.lit(f"{table}.{column}").alias("field_name"), F.col(column).alias("key_text"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p6_found": """
with c as (select 'cand.o' as field_name, o as key_text, count(*) as n from cand group by o
           union all select 's1.n_core', n_core, count(*) from s1 group by n_core),
t as (select 'cand.o' as field_name, count(*) as n_all from cand union all select 's1.n_core', count(*) from s1)
select c.field_name, c.key_text from c join t on c.field_name = t.field_name
where c.key_text is not null and c.key_text <> '' and c.n >= 0.02 * t.n_all""",
    "p6_counts": """
select 'cand.o' as field_name, o as key_text, cast(count(*) as bigint) as n_rows from cand group by o
union all select 's1.n_core', n_core, cast(count(*) as bigint) from s1 group by n_core""",
}
