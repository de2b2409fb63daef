"""Features of candidate pairs. Pairs have ``c1`` and ``co`` (names), ``d1`` and ``do`` (addresses), ``m1`` and ``mo`` (numbers),
``g1`` and ``go`` (legal forms), ``t1`` and ``to`` (states), each a space-joined string; missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import kernels as k
from kinloom.functions.text import words
from kinloom.session import evenly


def attach(pairs: DataFrame, records: DataFrame, cols: dict[str, str], how: str = "inner") -> DataFrame:
    """Columns of both records beside each pair: ``cols`` maps a record column to the stem of its two names. J7 with ``how``
    left: pairs whose records are missing stay, with '' for what is missing."""
    left = records.filter("side = 1").select(F.col("id").alias("s1"), *[F.col(c).alias(f"{stem}1") for c, stem in cols.items()])
    right = records.filter("side = 0").select(F.col("id").alias("o"), *[F.col(c).alias(f"{stem}o") for c, stem in cols.items()])
    out = pairs.join(left, "s1", how).join(right, "o", how)
    return out.na.fill("", [f"{stem}{x}" for stem in cols.values() for x in "1o"]) if how == "left" else out


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(F.size(part), F.size(whole)), 6)


def overlap(a: Column, b: Column, stem: str) -> dict[str, Column]:
    """Jaccard and both containments of token sets; missing if a side is empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both, either = F.array_intersect(x, y), F.array_union(x, y)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return {f"{stem}_jac": F.when(some, _share(both, either)), f"{stem}_cont1": F.when(some, _share(both, x)), f"{stem}_conto": F.when(some, _share(both, y))}


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """First numbers equal (1), the first found at all (0.5) or not (0); Jaccard; containment in the first side."""
    x, y = words(a), words(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    first = F.when(x[0] == y[0], 1.0).when(F.array_contains(y, x[0]), 0.5).otherwise(0.0)
    dx, dy = F.array_distinct(x), F.array_distinct(y)
    both = F.array_intersect(dx, dy)
    return {
        "num_first": F.when(some, first),
        "num_jac": F.when(some, _share(both, F.array_union(dx, dy))),
        "num_cont1": F.when(some, _share(both, dx)),
    }


def legal_eq(a: Column, b: Column) -> Column:
    """X11: equal sets 1, overlapping 0.5, else 0; missing if a side is empty."""
    x, y = F.array_sort(F.array_distinct(words(a))), F.array_sort(F.array_distinct(words(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), None).when(x == y, 1.0).when(F.arrays_overlap(x, y), 0.5).otherwise(0.0)


def state_eq(a: Column, b: Column) -> Column:
    """X12."""
    return F.when((a == "") | (b == ""), None).when(a == b, 1.0).otherwise(0.0)


def flags(core_1: Column, core_o: Column, addr_o: Column, o_id: Column, domain_o: Column | None = None) -> dict[str, Column]:
    """X13; ``domain_o`` says whether the second name is a web address."""
    return {
        "len_core_1": F.size(words(core_1)).cast("bigint"),
        "len_core_o": F.size(words(core_o)).cast("bigint"),
        "addr_empty_o": F.when(addr_o == "", 1).otherwise(0).cast("bigint"),
        **({"is_dom_o": domain_o.cast("bigint")} if domain_o is not None else {}),
        "src3": F.when(F.startswith(o_id, F.lit("S3")), 1).otherwise(0).cast("bigint"),
    }


def name_similarities(a: Column, b: Column) -> dict[str, Column]:
    """The kernels on names and on names without spaces."""
    compact = lambda c: F.regexp_replace(c, " ", "")
    of = {
        "nm_ratio": (k.ratio, a, b), "nm_tsort": (k.token_sort_ratio, a, b), "nm_tset": (k.token_set_ratio, a, b),
        "nm_partial": (k.partial_ratio, a, b), "nm_wratio": (k.weighted_ratio, a, b), "nm_compact": (k.ratio, compact(a), compact(b)),
        "nm_compact_partial": (k.partial_ratio, compact(a), compact(b)), "nm_jw": (k.jaro_winkler, a, b),
    }
    return {name: F.round(k.pairwise(f)(x, y), 6) for name, (f, x, y) in of.items()}


def address_similarities(a: Column, b: Column) -> dict[str, Column]:
    """Missing if the second address is empty."""
    of = {"ad_tset": k.token_set_ratio, "ad_tsort": k.token_sort_ratio, "ad_partial": k.partial_ratio}
    return {name: F.when(b != "", F.round(k.pairwise(f)(a, b), 6)) for name, f in of.items()}


def document_frequencies(records: DataFrame, column: str) -> DataFrame:
    """(token, df, idf) over all records; a token counts once a record."""
    n = records.count()
    tokens = records.select(F.explode(F.array_distinct(words(F.col(column)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.log(1 + F.lit(float(n)) / F.col("df")), 6))


def token_weights(records: DataFrame, column: str, idf: DataFrame) -> DataFrame:
    """(id, side, toks, idfs): weights beside the tokens of each record, looked up once a record, not once a pair."""
    tokens = records.select("id", "side", F.posexplode(words(F.col(column))).alias("pos", "token")).join(idf.select("token", "idf"), "token")
    held = tokens.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "idf"))).alias("t"))
    return held.select("id", "side", F.col("t.token").alias("toks"), F.col("t.idf").alias("idfs"))


def coverage(t: Column, w: Column, u: Column, near: Column) -> tuple[Column, Column, Column]:
    """X10 in one direction: share of the tokens ``t`` (repeated ones count each) that ``u`` has exactly or nearly, plain and weighted by
    ``w``, and the weighted share of those it has exactly; missing if a side has no token."""
    exact = F.transform(t, lambda x: F.array_contains(u, x))
    hit = F.zip_with(exact, near, lambda e, n: e | n)
    total = F.aggregate(w, F.lit(0.0), lambda x, y: x + y)
    weigh = lambda flags_: F.aggregate(F.zip_with(flags_, w, lambda f, v: F.when(f, v).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    some = lambda c: F.when((F.size(t) > 0) & (F.size(u) > 0), F.round(c, 6))
    return some(F.size(F.filter(hit, lambda x: x)) / F.size(t)), some(F.try_divide(weigh(hit), total)), some(F.try_divide(weigh(exact), total))


def _weighted_pairs(pairs: DataFrame, weights: DataFrame, stem: str) -> DataFrame:
    """Adds the tokens and weights of both sides; records without tokens have none."""
    out = pairs
    for side, key, mark in ((1, "s1", "1"), (0, "o", "o")):
        own = weights.filter(F.col("side") == side).select(F.col("id").alias(key), F.col("toks").alias(f"{stem}t{mark}"), F.col("idfs").alias(f"{stem}w{mark}"))
        out = out.join(own, key, "left").withColumns(
            {f"{stem}t{mark}": F.coalesce(f"{stem}t{mark}", F.array().cast("array<string>")), f"{stem}w{mark}": F.coalesce(f"{stem}w{mark}", F.array().cast("array<double>"))}
        )
    return out


def fuzzy_coverage(pairs: DataFrame, weights: DataFrame, least: int = 85) -> DataFrame:
    """X10 of names, from the first side: (s1, o, fcov, wcov, wexact)."""
    both = evenly(_weighted_pairs(pairs, weights, "n")).withColumn("near", k.near_flags(least)("nt1", "nto"))
    return both.select("s1", "o", *[c.alias(x) for x, c in zip(("fcov", "wcov", "wexact"), coverage(F.col("nt1"), F.col("nw1"), F.col("nto"), F.col("near")), strict=True)])


def coverages(pairs: DataFrame, names: DataFrame, addresses: DataFrame, least: int = 85) -> DataFrame:
    """The ten features of names and addresses from both sides, by the weights of :func:`token_weights`."""
    both = evenly(_weighted_pairs(_weighted_pairs(pairs.select("s1", "o"), names, "nm"), addresses, "ad"))
    out: dict[str, Column] = {}
    for stem in ("nm", "ad"):
        for mine, other, end in (("1", "o", ""), ("o", "1", "_o")):
            t, w, u = (F.col(f"{stem}{x}") for x in (f"t{mine}", f"w{mine}", f"t{other}"))
            both = both.withColumn(f"{stem}near{end}", k.near_flags(least)(t, u))
            f, v, e = coverage(t, w, u, F.col(f"{stem}near{end}"))
            out |= {f"{stem}_fcov{end}": f, f"{stem}_wcov{end}": v, **({f"{stem}_wexact": e} if not end else {})}
    return both.select("s1", "o", *[c.alias(x) for x, c in out.items()])


#: Columns of ``records`` that the feature table reads, and the stems of their two names.
STEMS = {"n_full": "f", "n_core": "c", "n_alt": "alt", "n_legal": "g", "n_dom": "dom", "a_norm": "d", "a_nums": "m", "a_state": "t"}


def feature_table(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """All features of stage 1 beside the columns of ``pairs``; ``records`` has the columns of ``STEMS``."""
    n = evenly(attach(pairs, records, STEMS))
    c1, co, d1, do = (F.col(x) for x in ("c1", "co", "d1", "do"))
    cols = name_similarities(c1, co) | address_similarities(d1, do) | overlap(c1, co, "nm") | overlap(d1, do, "ad") | number_features(F.col("m1"), F.col("mo"))
    cols |= {
        "nm_full_tsort": F.round(k.pairwise(k.token_sort_ratio)("f1", "fo"), 6),
        "nm_alt_tset": F.when(F.col("alto") != "", F.round(k.pairwise(k.token_set_ratio)("c1", "alto"), 6)),
        "legal_eq": legal_eq(F.col("g1"), F.col("go")),
        "state_eq": state_eq(F.col("t1"), F.col("to")),
    }
    cols |= flags(c1, co, do, F.col("o"), F.col("domo"))
    table = n.select(*pairs.columns, *[c.alias(x) for x, c in cols.items()])
    weights = [token_weights(records, c, document_frequencies(records, c)) for c in ("n_core", "a_norm")]
    return table.join(coverages(pairs, *weights), ["s1", "o"])
