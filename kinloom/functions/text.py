"""Normalisers of names and addresses as Column expressions. Only non-ASCII text goes through an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import lexicon as lx

_ASCII = r"^[\x00-\x7F]*$"
_HIDDEN = dict.fromkeys([*range(0x200B, 0x2010), 0xFEFF])
_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "’": "'"}
# Sounds of letters whose Unicode names spell them otherwise.
_SOUNDS = {"tta": "ta", "ttha": "tha", "dda": "da", "ddha": "dha", "nna": "na", "lla": "la", "rra": "ra", "ssa": "sha", "ca": "cha", "cha": "chha"}
_NATIVE = re.compile("[ऀ-෿]+")


def _native_word(word: str, learned: dict[str, str]) -> str:
    """A learned spelling, or the letters by the sounds in their Unicode names, with a silent last vowel."""
    if word in learned:
        return learned[word]
    out, open_ = [], False
    for ch in word:
        name = unicodedata.name(ch, "")
        sound = name.rsplit(" ", 1)[-1].lower()
        sound = _SOUNDS.get(sound, sound)
        if "VOWEL SIGN" in name:
            out.append(sound[0] if len(sound) > 1 and sound[0] == sound[-1] else sound)
            open_ = False
        elif "VIRAMA" in name:
            open_ = False
        elif "LETTER" in name and len(sound) > 1 and sound.endswith("a") and sound != "aa":
            out.append(("a" if open_ else "") + sound[:-1])
            open_ = True
        else:
            out.append(("a" if open_ else "") + (sound if "LETTER" in name else "n" if "ANUSVARA" in name else ""))
            open_ = False
    return "".join(out)


def romanise_text(text: str | None, learned: dict[str, str] | None = None) -> str:
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", text).translate(_HIDDEN)
    text = _NATIVE.sub(lambda m: f" {_native_word(m[0], learned or {})} ", text)
    text = "".join(_LETTERS.get(c, c) for c in text.lower())
    text = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode()
    return " ".join(text.split())


def romanise(col: Column, learned: dict[str, str] | None = None) -> Column:
    """Latin lower-case form; '' for NULL. ASCII stays in the JVM."""

    @F.pandas_udf(T.StringType())
    def slow(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else romanise_text(x, learned) for x in s.tolist()], dtype=object)

    plain = F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))
    ascii_ = F.coalesce(col, F.lit("")).rlike(_ASCII)
    return F.coalesce(F.when(ascii_, plain).otherwise(slow(F.when(~ascii_, col))), F.lit(""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def words(col: Column) -> Column:
    """Tokens of a space-joined string; none for ''."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def in_list(w: Column, values: list[str]) -> Column:
    return w.isin(*values)


def lookup(w: Column, table: dict[str, str]) -> Column:
    """The table's value, or the token itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), w), w)


def deleet(w: Column) -> Column:
    """Letters for digits in a token that has at least two letters."""
    letters = F.length(F.regexp_replace(w, "[^a-z]", ""))
    first = F.regexp_replace(w, "^1", "i")
    return F.when(w.rlike("^[0-9]+$") | (letters < 2), w).otherwise(F.translate(first, *lx.LEET))


def legal_typo(w: Column) -> Column:
    """The legal word that a long token is a mistyped form of, else the token."""
    out = w
    for word, short in reversed(lx.LEGAL_LONG):
        most = 1 if len(word) < 8 else 2
        out = F.when((F.abs(F.length(w) - len(word)) <= 2) & (F.levenshtein(w, F.lit(word)) <= most), F.lit(short)).otherwise(out)
    return F.when((F.length(w) >= 6) & ~in_list(w, list(lx.LEGAL)), out).otherwise(w)


def merge_spelt(col: Column) -> Column:
    """Spelt-out legal forms run together, in their order of trial."""
    return reduce(lambda c, seq: F.regexp_replace(c, rf"\b{seq}\b", seq.replace(" ", "")), lx.LEGAL_SPELT, col)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def name_tokens(col: Column) -> Column:
    """Clean tokens of romanised text, joined by single spaces."""
    text = F.regexp_replace(F.regexp_replace(col, "[&+]", " and "), r"\.", "")
    text = F.regexp_replace(text, "[^a-z0-9 ]+", " ")
    # two steps, as the second looks at the token many times
    tokens = F.transform(F.transform(words(text), deleet), legal_typo)
    return squeeze(merge_spelt(F.array_join(tokens, " ")))


def strip_id_tag(col: Column) -> Column:
    """Reference numbers with their mark."""
    return F.regexp_replace(col, r"\b(?:id|ref|reg)\b\s*(?:no\b)?\s*[:#.]*\s*[0-9]+", " ")


def domain_host(col: Column) -> Column:
    """The host of a web address, '' if there is none or more than two words."""
    host = F.regexp_extract(col, rf"\b([a-z0-9][a-z0-9-]*)\s*\.\s*(?:{'|'.join(lx.DOMAIN_ENDS)})\b", 1)
    return F.when(F.size(words(squeeze(col))) <= 2, F.regexp_replace(host, "-", " ")).otherwise(F.lit(""))


ALT = rf"\b(?:{'|'.join(lx.ALT_MARKS)})\b"


def core_words(col: Column) -> Column:
    """The words that are no legal form, stop word, honorific or long number."""
    drop = [*lx.LEGAL, *lx.STOP, *lx.HONORIFIC]
    return F.array_join(F.filter(words(col), lambda w: ~in_list(w, drop) & ~w.rlike("^[0-9]{5,}$")), " ")


def legal_words(col: Column) -> Column:
    """Sorted distinct canonical legal forms."""
    found = F.filter(words(col), lambda w: in_list(w, list(lx.LEGAL)))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda w: lookup(w, lx.LEGAL)))), " ")


NAME_COLUMNS = ("n_full", "n_core", "n_alt", "n_legal", "n_dom")


def norm_name(df: DataFrame, col: str, learned: dict[str, str] | None = None) -> DataFrame:
    """Adds n_full, n_core, n_alt, n_legal, n_dom. The romanised text is a column first: array functions take no UDF."""
    return _with_name(df.withColumn("_text", romanise(F.col(col), learned)), "_text").drop("_text")


def _with_name(df: DataFrame, text: str) -> DataFrame:
    read = df.withColumn("_name", norm_romanised_name(F.col(text)))
    return read.withColumns({c: F.col("_name")[i] for i, c in enumerate(NAME_COLUMNS)}).withColumn("n_dom", F.col("n_dom").cast("tinyint")).drop("_name")


def norm_romanised_name(text: Column) -> Column:
    """An array of ``NAME_COLUMNS``, all as strings: a struct's fields would be taken apart and each be worked out from the text."""

    def cut(full: Column, host: Column) -> Column:
        at = F.regexp_instr(full, F.lit(ALT))
        left = F.trim(F.when(at > 0, F.substring(full, F.lit(1), at - 1)).otherwise(full))
        right = F.when(at > 0, F.trim(F.regexp_replace(F.substring(full, at, F.length(full)), "^" + ALT, ""))).otherwise(F.lit(""))
        return F.array(left, core_words(left), core_words(right), legal_words(left), F.when(host != "", "1").otherwise("0"))

    def read(text: Column) -> Column:
        return once(domain_host(text), lambda host: once(name_tokens(F.when(host != "", host).otherwise(text)), lambda full: cut(full, host)))

    return once(strip_id_tag(text), read)


def state_code(text: Column, country: Column) -> Column:
    """The last component that names a state, or is a code among several components; '' if none."""

    def last_state(parts: Column) -> Column:
        out = F.lit("")
        for label, table in lx.STATES.items():
            names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
            several = F.size(parts) > 1
            codes = sorted(set(table.values()))
            hits = F.filter(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), F.when(several & in_list(p, codes), p))), lambda x: x.isNotNull())
            out = F.when(country == label, F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(""))).otherwise(out)
        return out

    return once(F.transform(F.split(text, ","), lambda p: squeeze(F.regexp_replace(p, "[^a-z0-9 ]+", " "))), last_state)


def states_to_codes(text: Column, country: Column) -> Column:
    """Full state names anywhere in the text replaced by codes, the longest first."""
    out = text
    for label, table in lx.STATES.items():
        swapped = reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", kv[1]), sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0])), text)
        out = F.when(country == label, swapped).otherwise(out)
    return out


def strip_ordinals(text: Column) -> Column:
    """N11."""
    return F.regexp_replace(text, r"\b([0-9]+)(?:st|nd|rd|th)\b", "$1")


def collapse_ranges(text: Column) -> Column:
    """A-b becomes a if both have as many digits and b is above a by less than 50."""
    spaced = F.regexp_replace(text, r"\b([0-9]+)\s*-\s*([0-9]+)\b", "$1-$2")

    def one(w: Column) -> Column:
        a, b = F.regexp_extract(w, r"\b([0-9]+)-([0-9]+)\b", 1), F.regexp_extract(w, r"\b([0-9]+)-([0-9]+)\b", 2)
        gap = F.expr("0") + (b.try_cast("bigint") - a.try_cast("bigint"))
        short = (a != "") & (F.length(a) == F.length(b)) & (F.length(a) <= 18)
        return F.when(F.contains(w, F.lit("-")) & short & F.coalesce((gap > 0) & (gap < 50), F.lit(False)), F.regexp_replace(w, r"\b([0-9]+)-[0-9]+\b", "$1")).otherwise(w)

    return F.array_join(F.transform(F.split(spaced, " "), one), " ")


def strip_units(text: Column) -> Column:
    """N13."""
    return F.regexp_replace(text, rf"\b(?:{'|'.join(lx.UNITS)})\b\s*[a-z]?[0-9]*[a-z]?\b", " ")


def address_tokens(text: Column) -> Column:
    """Canonical tokens without fillers."""
    clean = F.regexp_replace(text, "[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(F.transform(words(clean), lambda w: lookup(w, lx.ADDRESS)), lambda w: ~in_list(w, lx.ADDRESS_DROP)), " ")


def address_numbers(tokens: Column) -> Column:
    """All digit runs without leading zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(tokens, F.lit("([0-9]+)"), 1), lambda d: F.regexp_replace(d, "^0+(?=.)", "")), " ")


ADDRESS_COLUMNS = ("a_norm", "a_nums", "a_state")


def norm_addr(df: DataFrame, col: str, country: str = "country", learned: dict[str, str] | None = None) -> DataFrame:
    """Adds a_norm, a_nums, a_state; three empty strings for blank text."""
    return _with_addr(df.withColumn("_text", romanise(F.col(col), learned)), "_text", country).drop("_text")


def _with_addr(df: DataFrame, text: str, country: str) -> DataFrame:
    read = df.withColumn("_address", norm_romanised_addr(F.col(text), F.col(country)))
    return read.withColumns({c: F.col("_address")[i] for i, c in enumerate(ADDRESS_COLUMNS)}).drop("_address")


def norm_record(df: DataFrame, name: str, address: str, country: str = "country") -> DataFrame:
    """N9 and N16. Both texts are romanised first: what stands below a UDF is planned again for every column that reads it."""
    texts = df.withColumns({"_name_text": romanise(F.col(name)), "_address_text": romanise(F.col(address))})
    return _with_addr(_with_name(texts, "_name_text"), "_address_text", country).drop("_name_text", "_address_text")


def norm_romanised_addr(text: Column, country: Column) -> Column:
    """An array of ``ADDRESS_COLUMNS``."""
    body = strip_units(collapse_ranges(strip_ordinals(states_to_codes(F.regexp_replace(text, "#", " "), country))))
    return once(address_tokens(body), lambda norm: F.array(norm, address_numbers(norm), state_code(text, country)))


def clean_addr(text: Column) -> Column:
    """The folded number sign."""
    return F.regexp_replace(text, r"\bndeg", " ")
