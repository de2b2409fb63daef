"""Word-level helpers shared by the operators on names and addresses: folding, romanising, deletion neighbourhoods."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from kinloom.llm.forms import ordinary

INDIC = re.compile("[ऀ-෿]")
_SPECIAL = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "’": "'", "‘": "'"})
_MARKS = re.compile("[̀-ͯ]")
# Digits typed for the letters under them.
DIGIT_LETTERS = str.maketrans("0134567892", "oieasgtbgz")


@lru_cache(maxsize=4096)
def _indic_sound(ch: str) -> tuple[str, str]:
    """(kind, Latin sound) of an Indic character, from its Unicode name: consonant, vowel, sign, virama, digit or other."""
    name = unicodedata.name(ch, "")
    tail = name.rsplit(" ", 1)[-1].lower() if name else ""
    long = {"aa": "a", "ii": "i", "uu": "u", "ee": "e", "oo": "o", "ai": "ai", "au": "au", "ssa": "sha", "tta": "ta", "ttha": "tha", "dda": "da", "ddha": "dha", "nna": "na", "lla": "la", "rra": "ra", "ca": "cha", "cha": "chha", "nga": "nga", "nya": "nya"}
    tail = long.get(tail, tail)
    if "LETTER" in name:
        return ("consonant", tail[:-1]) if tail.endswith("a") and len(tail) > 1 and not tail.endswith("aa") else ("vowel", tail)
    if "VOWEL SIGN" in name:
        return "sign", tail
    if "VIRAMA" in name:
        return "virama", ""
    if "ANUSVARA" in name:
        return "other", "n"
    if "DIGIT" in name:
        return "other", str(unicodedata.digit(ch, 0))
    return "other", ""


def romanise(text: str) -> str:
    """Indic letters to Latin ones by sound; the inherent vowel is silent at a word's end. Other text is untouched."""
    if not INDIC.search(text):
        return text
    # (a space ends whatever is pending)
    return " ".join([w if w.isascii() else _romanised(w) for w in text.split(" ")])


@lru_cache(maxsize=20_000)
def _romanised(text: str) -> str:
    out: list[str] = []
    pending = False
    for ch in text:
        if "ऀ" <= ch <= "෿":
            kind, sound = _indic_sound(ch)
            if kind == "consonant":
                if pending:
                    out.append("a")
                out.append(sound)
                pending = True
            elif kind in ("sign", "virama"):
                out.append(sound)
                pending = False
            else:
                if pending and kind == "vowel":
                    out.append("a")
                out.append(sound)
                pending = False
        else:
            pending = False
            out.append(ch)
    return "".join(out)


def fold(text: str) -> str:
    """Ordinary characters, Indic romanised, no accents, lower case."""
    if text.isascii():
        return text.lower()
    text = romanise(ordinary(text)).lower()
    if text.isascii():
        return text
    try:
        return _OTHERS.sub(lambda m: _plain[m[0]], text)
    except _ReorderedError:
        return _MARKS.sub("", unicodedata.normalize("NFD", text.translate(_SPECIAL)))


_OTHERS = re.compile("[^\x00-\x7f]")


class _ReorderedError(Exception):
    """A character with marks that stay, whose order depends on those beside them."""


class _Plain(dict[str, str]):
    """Small characters beyond ASCII without their marks, kept once they were met."""

    def __missing__(self, ch: str) -> str:
        got = _MARKS.sub("", unicodedata.normalize("NFD", ch.translate(_SPECIAL)))
        if any(unicodedata.combining(c) for c in got):
            raise _ReorderedError
        self[ch] = got
        return got


_plain = _Plain()


def any_of(words: Iterable[str]) -> str:
    """A pattern of any of some plain words, the longest that fits, written as a tree of their letters: as it stands, one list
    of words would be tried word by word at every place."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(c) + (any_of(t) + "?" * ("" in t) if any(t) else "") for c, t in tails.items()) + ")"


def deletions(word: str) -> set[str]:
    """The word and every word that arises by deleting one character; two words that share one are within two edits."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with neighbouring transpositions; limit + 1 as soon as it must exceed the limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


class Lexicon:
    """Known words with one-edit lookup through their deletion neighbourhoods."""

    def __init__(self, words: dict[str, str], fuzzy_from: int = 5) -> None:
        self.words = words
        self.fuzzy_from = fuzzy_from
        self.longest = max(map(len, words))
        # one edit, or one transposition, leaves that many letters at the start or at the end of a token as they are
        known = [w for w in words if len(w) >= fuzzy_from]
        sizes = [(n - 1) // 2 for n in range(self.longest + 2)]
        self.starts = [{w[:h] for w in known} for h in sizes]
        self.ends = [{w[len(w) - h :] for w in known} for h in sizes]
        self.near: dict[str, set[str]] = {}
        for w in words:
            if len(w) >= fuzzy_from:
                for d in deletions(w):
                    self.near.setdefault(d, set()).add(w)

    def find(self, token: str) -> str | None:
        """What the token stands for: itself, or a word of at least ``fuzzy_from`` letters one edit away."""
        got = self.words.get(token)
        if got is not None or not self.fuzzy_from - 1 <= len(token) <= self.longest + 1:
            return got
        n = len(token)
        h = (n - 1) // 2
        if token[:h] not in self.starts[n] and token[n - h :] not in self.ends[n]:
            return None
        best: tuple[int, str] | None = None
        for d in deletions(token):
            for w in self.near.get(d, ()):
                n = osa(token, w, 1)
                if n <= 1 and (best is None or (n, w) < best):
                    best = (n, w)
        return self.words[best[1]] if best else None
