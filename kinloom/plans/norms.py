"""Queries of the normalisers over all names and addresses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import lexicon as lx
from kinloom.functions import text as t
from kinloom.plans.records import others, table
from kinloom.session import evenly

_COLS = ["entity_id", "business_name", "business_address", "country"]


def _all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "s1").select(_COLS).unionByName(others(spark, d))


def _flat(col: str) -> F.Column:
    """Lower case, every other character than a-z, 0-9 and the marks that the rules look at made a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^a-z0-9,:#.\-]+", " "), r"\s+", " "))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _all(spark, d).select(F.explode(t.words(F.regexp_replace(_flat("business_name"), "[^a-z0-9]+", " "))).alias("token"))
    return rows.distinct()


def norm_names(spark: SparkSession, d: str) -> DataFrame:
    return t.norm_name(evenly(_all(spark, d)), "business_name").select("entity_id", "n_full", "n_core", "n_alt", "n_legal", "n_dom")


def norm_addresses(spark: SparkSession, d: str) -> DataFrame:
    return t.norm_addr(evenly(_all(spark, d)), "business_address").select("entity_id", "a_norm", "a_nums", "a_state")


def deleet_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", t.deleet(F.col("token")).alias("letters"))


def legal_typos(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("token", t.legal_typo(F.col("token")).alias("legal"))


def spelt_forms(spark: SparkSession, d: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(_flat("business_name"), "[^a-z0-9]+", " "))
    return _all(spark, d).select("entity_id", t.merge_spelt(plain).alias("merged"))


def name_cores(spark: SparkSession, d: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(_flat("business_name"), "[^a-z0-9]+", " "))
    return _all(spark, d).select("entity_id", t.core_words(plain).alias("n_core"), t.legal_words(plain).alias("n_legal"))


def id_tags(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.squeeze(t.strip_id_tag(_flat("business_name"))).alias("name"))


def domains(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.domain_host(_flat("business_name")).alias("host"))


def alt_names(spark: SparkSession, d: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(_flat("business_name"), "[^a-z0-9]+", " "))
    at = F.regexp_instr(plain, F.lit(t.ALT))
    left = F.trim(F.when(at > 0, F.substring(plain, F.lit(1), at - 1)).otherwise(plain))
    return _all(spark, d).select("entity_id", left.alias("own"), F.when(at > 0, 1).otherwise(0).cast("bigint").alias("has_alt"))


def state_codes(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.state_code(_flat("business_address"), F.col("country")).alias("a_state"))


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.strip_ordinals(_flat("business_address")).alias("address"))


def range_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.collapse_ranges(_flat("business_address")).alias("address"))


def units_removed(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("entity_id", t.squeeze(t.strip_units(_flat("business_address"))).alias("address"))


def address_tokens(spark: SparkSession, d: str) -> DataFrame:
    norm = t.address_tokens(_flat("business_address"))
    return _all(spark, d).select("entity_id", norm.alias("a_norm"), t.address_numbers(norm).alias("a_nums"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_names, norm_addresses, deleet_tokens, legal_typos, spelt_forms, name_cores, id_tags, domains, alt_names, state_codes, ordinals, range_collapse,
        units_removed, address_tokens,
    )
}

_ALL = """al as (select entity_id, business_name, business_address, country from s1 union all
  select entity_id, any_value(business_name), any_value(business_address), any_value(country)
  from (select entity_id, business_name, business_address, country from s2 union all select entity_id, business_name, business_address, country from s3) group by entity_id)"""


def _f(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9,:#.\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_NAME = f"trim(regexp_replace({_f('business_name')}, '[^a-z0-9]+', ' ', 'g'))"
_TOK = f"{_ALL}, tk as (select distinct token from (select unnest(string_split({_NAME}, ' ')) as token from al) where token <> '')"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(table_: dict[str, str], x: str) -> str:
    return f"coalesce(map({{{', '.join(f"'{k}': '{v}'" for k, v in table_.items())}}})[{x}], {x})".replace("map({", "map {").replace("})[", "}[")


def _nested(expr: str, steps: list[tuple[str, str]]) -> str:
    for a, b in steps:
        expr = f"regexp_replace({expr}, '{a}', '{b}', 'g')"
    return expr


_TYPO = (
    f"case when length(token) >= 6 and token not in {_list(list(lx.LEGAL))} then case "
    + " ".join(f"when abs(length(token) - {len(w)}) <= 2 and levenshtein(token, '{w}') <= {1 if len(w) < 8 else 2} then '{s}'" for w, s in lx.LEGAL_LONG)
    + " else token end else token end"
)
_STATES = " ".join(
    f"when country = '{label}' then coalesce(list_filter(list_transform(parts, lambda p: case when p in {_list(list(names))} then {_map(names, 'p')} when length(parts) > 1 and p in {_list(sorted(set(names.values())))} then p end), lambda x: x is not null)[-1], '')"
    for label, names in lx.STATES.items()
)
_W = "list_filter(string_split({}, ' '), lambda w: w <> '')"
_CORE_DROP = _list([*lx.LEGAL, *lx.STOP, *lx.HONORIFIC])
_ADDR = f"list_filter(list_transform({_W.format('trim(regexp_replace(' + _f('business_address') + ', ' + chr(39) + '[^a-z0-9]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')}, lambda w: {_map(lx.ADDRESS, 'w')}), lambda w: w not in {_list(lx.ADDRESS_DROP)})"
SQL = {
    "deleet_tokens": f"""with {_TOK} select token, case when regexp_full_match(token, '[0-9]+') or length(regexp_replace(token, '[^a-z]', '', 'g')) < 2 then token
else translate(regexp_replace(token, '^1', 'i'), '{lx.LEET[0]}', '{lx.LEET[1]}') end as letters from tk""",
    "legal_typos": f"with {_TOK} select token, {_TYPO} as legal from tk",
    "spelt_forms": f"with {_ALL} select entity_id, {_nested(_NAME, [(chr(92) + 'b' + s + chr(92) + 'b', s.replace(' ', '')) for s in lx.LEGAL_SPELT])} as merged from al",
    "name_cores": f"""with {_ALL}, w as (select entity_id, {_W.format(_NAME)} as w from al)
select entity_id, array_to_string(list_filter(w, lambda x: x not in {_CORE_DROP} and not regexp_full_match(x, '[0-9]{{5,}}')), ' ') as n_core,
array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: x in {_list(list(lx.LEGAL))}), lambda x: {_map(lx.LEGAL, 'x')}))), ' ') as n_legal from w""",
    "id_tags": f"with {_ALL} select entity_id, trim(regexp_replace(regexp_replace({_f('business_name')}, '\\b(?:id|ref|reg)\\b\\s*(?:no\\b)?\\s*[:#.]*\\s*[0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) as name from al",
    "domains": f"""with {_ALL}, x as (select entity_id, {_f('business_name')} as n from al)
select entity_id, case when length({_W.format('n')}) <= 2 then replace(regexp_extract(n, '\\b([a-z0-9][a-z0-9-]*)\\s*\\.\\s*(?:{'|'.join(lx.DOMAIN_ENDS)})\\b', 1), '-', ' ') else '' end as host from x""",
    "alt_names": f"""with {_ALL}, x as (select entity_id, {_NAME} as n from al), y as (select *, regexp_extract(n, '{t.ALT}') as m from x)
select entity_id, trim(case when m <> '' then regexp_extract(n, '^(.*?)(?:{t.ALT})', 1) else n end) as own, cast(case when m <> '' then 1 else 0 end as bigint) as has_alt from y""",
    "state_codes": f"""with {_ALL}, x as (select entity_id, country, list_transform(string_split({_f('business_address')}, ','), lambda p: trim(regexp_replace(regexp_replace(p, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))) as parts from al)
select entity_id, case {_STATES} else '' end as a_state from x""",
    "ordinals": f"with {_ALL} select entity_id, regexp_replace({_f('business_address')}, '\\b([0-9]+)(?:st|nd|rd|th)\\b', '\\1', 'g') as address from al",
    "range_collapse": f"""with {_ALL}, x as (select entity_id, string_split(regexp_replace({_f('business_address')}, '\\b([0-9]+)\\s*-\\s*([0-9]+)\\b', '\\1-\\2', 'g'), ' ') as w from al)
select entity_id, array_to_string(list_transform(w, lambda v: case when length(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 1)) > 0
  and length(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 1)) = length(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 2)) and length(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 1)) <= 18
  and coalesce(try_cast(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 2) as bigint) - try_cast(regexp_extract(v, '\\b([0-9]+)-([0-9]+)\\b', 1) as bigint), 0) between 1 and 49
  then regexp_replace(v, '\\b([0-9]+)-[0-9]+\\b', '\\1', 'g') else v end), ' ') as address from x""",
    "units_removed": f"with {_ALL} select entity_id, trim(regexp_replace(regexp_replace({_f('business_address')}, '\\b(?:{'|'.join(lx.UNITS)})\\b\\s*[a-z]?[0-9]*[a-z]?\\b', ' ', 'g'), '\\s+', ' ', 'g')) as address from al",
    "address_tokens": f"""with {_ALL}, x as (select entity_id, {_ADDR} as w from al)
select entity_id, array_to_string(w, ' ') as a_norm, array_to_string(list_transform(regexp_extract_all(array_to_string(w, ' '), '[0-9]+'), lambda d: coalesce(nullif(ltrim(d, '0'), ''), '0')), ' ') as a_nums from x""",
}
