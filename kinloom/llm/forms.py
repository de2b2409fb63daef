"""Problem 4: text that looks the same in different characters.

One compiled transducer rewrites a value in a single pass. Its input symbols are grapheme clusters: a base
character with the marks and invisible characters that follow it. For every cluster the longest key of a
precomputed mapping is applied (ligatures, widths, composed accents, spaces). Look-alike letters need their
word as context, so the transducer keeps two outputs while it reads a word, one with look-alikes left alone
and one with them replaced, and picks one at the word's end: the replaced one if the word also has
Latin letters. A word of another script whose letters all have Latin twins is replaced only if the value shows Latin
letters elsewhere and no word that is surely of that script: КАССА alone, or beside МЕБЕЛЬ, is a genuine word.

Defined results: NULL stays NULL and is no case; empty and blank text stay as they are (ordinary spaces are
ordinary); text of any length is processed whole; repeated rows give one result row per (entity_id, field);
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like the Latin letter under them.
LOOK_ALIKES = [
    # Greek capitals, Greek small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("αινορυχκ", "aivopuxk"),
    # Cyrillic capitals, Cyrillic small letters
    ("АВЕКМНОРСТУХЅІЈԚԜҺ", "ABEKMHOPCTYXSIJQWh"),
    ("аеорсухѕіјһԛԝԁ", "aeopcyxsijhqwd"),
    # Armenian small letters
    ("ոօսհ", "nouh"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    # Lisu
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
]
# Latin letters of phonetic alphabets, and small capitals, that look like plain ones; replaced in any word.
LATIN_TWINS = ("ɡɑᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "gaabcdeghijklmnoprstuvwyz")
# First and last code point of the scripts that have look-alikes.
SCRIPTS = {"Greek": (0x370, 0x3FF), "Cyrillic": (0x400, 0x52F), "Armenian": (0x530, 0x58F), "Cherokee": (0x13A0, 0x13FF), "Lisu": (0xA4D0, 0xA4FF)}
# What joins or hides without being seen, beside all characters of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


# What is mapped of the code space: all but ASCII, Hangul syllables, surrogates, private use and plain ideographs.
PLANES = ((0xA0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def _nfkc(ch: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", ch))


def compile_mapping() -> dict[str, str]:
    """Cluster -> ordinary form, built by rule over all planes; raises if two rules disagree or an output is not final."""
    found: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if found.setdefault(key, value) != value:
            raise ValueError(f"conflict for {key!r}: {found[key]!r} and {value!r}")

    for code in (c for low, high in PLANES for c in range(low, high)):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in INVISIBLE or kind in ("Cf", "Me") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            put(ch, "")  # unseen, or a frame around a letter
        elif kind in ("Zs", "Zl", "Zp"):
            put(ch, " ")
        elif kind != "Cn" and (plain := _nfkc(ch)) != ch and not plain.startswith(" "):
            put(ch, plain)
    for ch, plain in zip(*LATIN_TWINS, strict=True):
        put(ch, plain)
    marks = [chr(c) for c in range(0x300, 0x370) if chr(c) not in INVISIBLE]
    for code in [*range(0x41, 0x250), *range(0x370, 0x530)]:
        base = chr(code)
        if base.isalpha():
            for mark in marks:
                composed = unicodedata.normalize("NFC", base + mark)
                if len(composed) == 1 and unicodedata.normalize("NFD", composed) != composed:
                    put(base + mark, composed)
    for key, value in found.items():  # an output may be input of another rule once, not more
        found[key] = "".join(found.get(c, c) for c in value)
    for key, value in found.items():
        if any(c in found for c in value):
            raise ValueError(f"output {value!r} of {key!r} is not final")
    return found


@lru_cache(maxsize=1)
def _machine() -> tuple[dict[str, str], dict[str, str], re.Pattern, re.Pattern]:
    mapping = compile_mapping()
    twins = {a: b for left, right in LOOK_ALIKES for a, b in zip(left, right, strict=True)}
    if clash := [c for c in twins if c in mapping]:
        raise ValueError(f"look-alikes that another rule maps: {clash}")
    # (of the other planes all that there is: the pattern only spares most values the transducer)
    singles = "".join(re.escape(c) for c in mapping if len(c) == 1 and c < "\U00010000") + "\U00010000-\U0010ffff"
    # a value is touched only if it has a mapped character, a mark, or a letter of a script with look-alikes
    ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS.values())
    suspect = re.compile(f"[{singles}\u0300-\u036f{ranges}]")
    word = re.compile(r"[^ \t\r\n\x00-\x1f]*[^\x00-\x7f][^ \t\r\n\x00-\x1f]*")
    return mapping, twins, suspect, word


def _script(ch: str) -> str:
    code = ord(ch)
    return next((name for name, (a, b) in SCRIPTS.items() if a <= code <= b), "")


def _genuine(text: str, mapping: dict[str, str], twins: dict[str, str]) -> set[str]:
    """The scripts whose look-alike words are to be left alone in a value: all if it has no Latin letter, else those of which it has a
    word without Latin letters that is not made of look-alikes only."""
    scripts: set[str] = set()
    any_latin = False
    for word in re.split(r"[\W\d_]+", text):
        latin = any(c.isalpha() and (c < "ɐ" or (mapping.get(c, c)[:1] or "?").isascii()) for c in word)
        any_latin |= latin
        if not latin:
            scripts |= {s for c in word if c not in twins and (s := _script(c))}
    return scripts if any_latin else set(SCRIPTS)


def _rewrite(word: str, mapping: dict[str, str], twins: dict[str, str], genuine: set[str]) -> str:
    """One pass over the clusters of a run without ordinary spaces; special spaces inside it end a word."""
    out: list[str] = []
    plain: list[str] = []
    swapped: list[str] = []
    latin = foreign = odd = False
    script = ""

    def close() -> None:
        nonlocal latin, foreign, odd, script
        out.extend(swapped if foreign and (latin or not odd and script not in genuine) else plain)
        plain.clear()
        swapped.clear()
        latin = foreign = odd = False
        script = ""

    i, n = 0, len(word)
    while i < n:
        ch = word[i]
        i += 1
        got = mapping.get(ch)
        if got == "":
            continue
        while i < n and (mapping.get(word[i]) == "" or "̀" <= word[i] <= "ͯ"):
            nxt = word[i]
            i += 1
            if mapping.get(nxt) == "":
                continue
            base = got if got is not None else ch
            longer = mapping.get(base + nxt)
            got = longer if longer is not None else base + nxt
        text = ch if got is None else got
        if text == " ":
            close()
            out.append(text)
            continue
        head = text[0]
        if head in twins:
            foreign, script = True, _script(head)
            plain.append(text)
            swapped.append(unicodedata.normalize("NFC", twins[head] + text[1:]))
            continue
        if head.isalpha():
            if head < "ɐ" or "Ḁ" <= head <= "ỿ":
                latin = True
            elif _script(head):
                foreign = odd = True
        elif not head.isdigit() and head not in "'’-.&":
            close()
            out.append(text)
            continue
        plain.append(text)
        swapped.append(text)
    close()
    return "".join(out)


def ordinary(text: str) -> str:
    """The one form in which equal-looking text is equal."""
    mapping, twins, suspect, word = _machine()
    if text.isascii() or not suspect.search(text):
        return text
    genuine = _genuine(text, mapping, twins) if any(c in twins for c in text) else set()
    return word.sub(lambda m: _rewrite(m[0], mapping, twins, genuine), text)


def ordinary_all(values: Iterable[str | None]) -> list[str | None]:
    return [None if v is None else ordinary(v) for v in values]


@F.pandas_udf(T.StringType())
def _ordinary_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(ordinary_all(s.tolist()), dtype=object)


NON_ASCII = "[^\\x00-\\x7F]"


def ordinary_form(col: Column) -> Column:
    """Column form of :func:`ordinary`; pure ASCII never leaves the JVM's value but is still sent with the batch."""
    return _ordinary_udf(col)


FIELDS = ("business_name", "business_address")


def long_fields(tables: Iterable[DataFrame], fields: Iterable[str] = FIELDS) -> DataFrame:
    """(entity_id, field_name, value): one row per field, for tables that share the columns."""
    fields = list(fields)
    out: DataFrame | None = None
    for t in tables:
        pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
        part = t.select("entity_id", F.explode(pairs).alias("p")).select("entity_id", "p.field_name", "p.value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table given")
    return out


def unify_forms(values: DataFrame) -> DataFrame:
    """Adds ``form``, the ordinary form, and ``is_case`` to (entity_id, field_name, value).

    Only values with a non-ASCII character go through the transducer; the others are their own form.
    """
    dirty = values.filter(F.col("value").rlike(NON_ASCII)).withColumn("form", ordinary_form(F.col("value")))
    clean = values.filter(~F.coalesce(F.col("value").rlike(NON_ASCII), F.lit(False))).withColumn("form", F.col("value"))
    # a separate is_case keeps NULL values as "no case"
    return dirty.unionByName(clean).withColumn("is_case", F.coalesce(F.col("form") != F.col("value"), F.lit(False)))


def find_disguised(tables: Iterable[DataFrame]) -> DataFrame:
    """(entity_id, field_name) of every value that is not stored in its ordinary characters; one row each."""
    values = long_fields(tables).filter(F.col("value").rlike(NON_ASCII))
    return (
        values.withColumn("form", ordinary_form(F.col("value")))
        .filter(F.col("form") != F.col("value"))
        .select("entity_id", "field_name")
        .distinct()
    )
