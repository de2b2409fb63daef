"""Reading organisation names: what is the own name, the trade, the given name, and what is filler."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from kinloom.llm.words import DIGIT_LETTERS, INDIC, Lexicon, fold

# Legal forms and their spelt-out words, also as commonly mistyped.
LEGAL = """inc incorporated incorporatd corp corporation corporaton co company llc llp lp ltd limited limted pvt private privte plc
sarl sas sa eurl sasu cie gmbh ag bv nv""".split()
LEGAL_LONG = "incorporated corporation company limited private".split()
# Titles before names.
TITLES = "m/s mr mrs ms miss dr smt shri sri shree mme mlle monsieur madame".split()
# Words that add nothing to a name.
FILLERS = "the and et und of de service services centre center shop store stores enterprise enterprises maison fils associes associe city".split()
# Words that make another body of it.
PARENTS = "group holding holdings trust foundation".split()
# Trades and their usual short forms.
TRADES = {
    "upholstery": "uphol", "furniture": "furn", "photography": "photo", "veterinary": "vet", "laundry": "lndry", "electronics": "elec",
    "chemicals": "chem", "insurance": "ins", "tailors": "tlrs", "bakery": "bkry", "manufacturing": "mfg", "hardware": "hdwe",
    "catering": "catrg", "construction": "constr", "realty": "rlty", "pharmacy": "pharm", "motors": "mtrs", "packaging": "pkg",
    "plumbing": "plbg", "textiles": "txtls", "engineering": "engg", "printing": "prtg", "logistics": "logist", "painting": "paintg",
    "consulting": "consltg", "jewellers": "jwlrs", "stationery": "staty", "landscaping": "landscp", "roofing": "roofg", "transport": "transp",
    "seafood": "", "dairy": "", "nursery": "", "ceramics": "", "travels": "", "foods": "", "optics": "", "wallpapers": "", "toolworks": "", "dental": "",
    "boulangerie": "boul", "transports": "transp", "peinture": "", "traiteur": "", "couverture": "", "imprimerie": "impr", "restauration": "resto",
    "carrelage": "", "coiffure": "", "electricite": "elec", "librairie": "libr", "menuiserie": "menuis", "maconnerie": "macon", "chaudronnerie": "",
    "serrurerie": "serr", "quincaillerie": "quinc", "jardinage": "", "garage": "", "optique": "", "fleuriste": "", "bijouterie": "bij",
    "fromagerie": "", "pharmacie": "pharm", "plomberie": "plomb",
}
# Second words of two-word trades, dropped beside their first.
TRADE_TAILS = {"dental": ("care",)}
# Given names and their short forms.
GIVEN = {
    "james": "jim jas jimmy", "william": "bill wm will", "robert": "bob rob", "richard": "dick rick", "charles": "chuck chas", "thomas": "tom thos",
    "joseph": "joe jos", "margaret": "peggy maggie", "elizabeth": "liz betty", "katherine": "kathy kate", "edward": "ned ed", "lawrence": "larry",
    "susan": "sue", "dorothy": "dot", "lakshmi": "laxmi", "padmavathi": "padma", "subramaniam": "subbu", "venkatesh": "venky", "srinivas": "srini",
    "rajendra": "raju", "chandrasekhar": "chandru", "mohammed": "md mohd", "guillaume": "guill", "francois": "frs", "frederic": "fred",
    "elisabeth": "babeth", "jean pierre": "", "marie claire": "",
}
# Marks of a second name. After the first kind the own name follows, before the second kind it stands.
OWN_AFTER = re.compile(r"\b(?:d\s*/\s*b\s*/\s*a|dba|trading\s+as|t\s*/\s*a|doing\s+business\s+as)\b[\s:]*")
OWN_BEFORE = re.compile(r"[(\[]?\s*\b(?:formerly(?:\s+known\s+as)?|f\s*/\s*k\s*/\s*a|fka|aka|a\s*/\s*k\s*/\s*a|also\s+known\s+as)\b.*$", re.S)

_DIGIT = re.compile("[0-9]")
_REFERENCE = re.compile(r"\(?\b(?:ref|id|reg)\b[\s.:#]*(?:n[o0]\b)?[\s.:#]*\d+\)?|#\s*\d+|\b\d{5,}\b")
_BRACKETS = re.compile(r"\([^)]*\)")
_DOMAIN = re.compile(r"^(?:www\.)?([a-z0-9\-]{4,})\.(?:co\.in|com|net|us|in|fr|org)$")
_SPELT = re.compile(r"(?<![a-z0-9])((?:[a-z] ){1,3}[a-z])(?![a-z0-9])")
_SPELT_FORMS = {"llc", "llp", "sas", "sarl", "eurl", "sa", "plc", "co"}
_LEAD = re.compile(r"^[^\w(\[]+|[^\w)\].]+$")
_NOT_WORD = re.compile(r"[^\w]+|_+")
_FOREIGN = re.compile("[Ͱ-ࣿ฀-ῼ぀-鿿가-힯]")
_SOUNDS = (("ph", "f"), ("cs", "ks"), ("ck", "k"), ("ch", "ç"), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "j"), ("w", "v"), ("ç", "ch"), ("ee", "i"), ("oo", "u"))


@lru_cache(maxsize=20_000)
def sound(word: str) -> str:
    """Spelling by sound, to compare romanised with English words."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return word


def _lexicons() -> tuple[Lexicon, dict[str, list[tuple[str, str]]], dict[str, str], Lexicon, dict[str, str]]:
    trades = {w: w for w in TRADES}
    for w, tails in TRADE_TAILS.items():
        trades |= {w + x: w for x in tails}
    suffixes = list(trades.items())
    for w, short in TRADES.items():
        if short:
            trades.setdefault(short, w)
            suffixes.append((short, trades[short]))
    by_sound = {sound(w): v for w, v in trades.items() if len(w) > 4}
    given: dict[str, str] = {}
    for w, shorts in GIVEN.items():
        for x in [w, *shorts.split()]:
            given[x] = w.replace(" ", "")
    given |= {"jeanpierre": "jeanpierre", "marieclaire": "marieclaire"}
    suffixes.sort(key=lambda x: -len(x[0]))
    by_end: dict[str, list[tuple[str, str]]] = {}
    for w, v in suffixes:
        by_end.setdefault(w[-1], []).append((w, v))
    return Lexicon(trades), by_end, by_sound, Lexicon(given), {sound(k): v for k, v in given.items() if len(k) > 4}


_TRADE, _TRADE_END, _TRADE_SOUND, _GIVEN, _GIVEN_SOUND = _lexicons()
# "elec", "pharm" and "transp" stand for one trade in each language: compared by their short form
_SAME_TRADE = {"electricite": "electronics", "pharmacie": "pharmacy", "transports": "transport"}
_LEGAL = set(LEGAL)
_LEGAL_NEAR = Lexicon({w: w for w in LEGAL_LONG}, 6)
_DROP = {*TITLES, *FILLERS}
_FILLER_NEAR = Lexicon({w: w for w in FILLERS if len(w) >= 6}, 6)
_PARENT = Lexicon({w: w.rstrip("s") if w == "holdings" else w for w in PARENTS}, 5)
# what is in no list, and begins and ends like no word of one, is a name: most tokens are
_LISTS = (_TRADE, _PARENT, _GIVEN, _LEGAL_NEAR, _FILLER_NEAR)
_WORDS = {w for x in _LISTS for w in x.words}
_LONGEST = max(x.longest for x in _LISTS) + 1
_STARTS, _ENDS = ([set().union(*(getattr(x, side)[n] for x in _LISTS if n <= x.longest + 1)) for n in range(_LONGEST + 1)] for side in ("starts", "ends"))
# three letters that trades of six letters or more begin and end with
_TRADE_3 = {w[:3] for w in _TRADE.words if len(w) >= 6}, {w[-3:] for w in _TRADE.words if len(w) >= 6}


class Name(NamedTuple):
    core: str  # the own name without spaces, given name, trade and fillers
    words: str  # the same, with spaces
    trade: str
    given: str  # canonical given name, or an initial
    parent: str  # holdings, group, trust, foundation


EMPTY = Name("", "", "", "", "")


@lru_cache(maxsize=200_000)
def _kind(token: str) -> tuple[str, str]:
    """What a token is: drop, legal, parent, trade, given or name, and its value."""
    if token in _LEGAL:
        return "legal", ""
    if token in _DROP:
        return "drop", ""
    if not token.isalpha() and not token.isdigit() and any(c.isdigit() for c in token):
        if got := _TRADE.words.get(token.replace("1", "l").translate(DIGIT_LETTERS)):
            return "trade", got
        token = token.translate(DIGIT_LETTERS)
        if token in _LEGAL or token in _DROP:
            return "drop", ""
    n = len(token)
    h = (n - 1) // 2
    if token not in _WORDS and (n > _LONGEST or n and token[:h] not in _STARTS[n] and token[n - h :] not in _ENDS[n]):
        return "name", token
    if got := _TRADE.find(token):
        return "trade", got
    if got := _PARENT.find(token):
        return "parent", got
    if got := _GIVEN.words.get(token):
        return "given", got
    if _LEGAL_NEAR.find(token) or _FILLER_NEAR.find(token):
        return "drop", ""
    if got := _GIVEN.find(token):
        return "given?", got
    return "name", token


@lru_cache(maxsize=50_000)
def _cut_trade(word: str) -> tuple[str, str]:
    """(rest, trade) of words run together, the trade at either end."""
    for w, v in _TRADE_END.get(word[-1], ()):
        if len(word) >= len(w) + 6 and word.endswith(w) and len(w) >= 4:
            return word[: -len(w)], v
    for k in range(12, 5, -1):
        if len(word) >= k + 6 and (got := _TRADE.find(word[-k:])) and abs(len(got) - k) <= 1:
            return word[:-k], got
    for k in range(13, 5, -1):
        if len(word) >= k + 6 and (got := _TRADE.words.get(word[:k])) and len(got) == k:
            return word[k:], got
    return word, ""


def own_part(text: str) -> str:
    """The own name of a folded text that may also give a former or second name."""
    # what a text with a second name contains at least: it spares most texts the patterns
    if not ("/" in text or "ka" in text or "dba" in text or "formerly" in text or "trading" in text or "doing" in text or "also" in text):
        return text
    if m := OWN_AFTER.search(text):
        rest = text[m.end() :]
        if rest.strip():
            text = rest
    cut = OWN_BEFORE.sub("", text)
    return cut if cut.strip() else text


def read_name(raw: str | None) -> Name:
    """Reads a name as typed. NULL, blank, and text without any own word give :data:`EMPTY` fields."""
    if not raw or raw.isspace():
        return EMPTY
    return _read_again(raw) if len(raw) < 100 else _read(raw)


@lru_cache(maxsize=50_000)
def _read_again(raw: str) -> Name:
    return _read(raw)


def _read(raw: str) -> Name:
    indic = not raw.isascii() and bool(INDIC.search(raw))
    text = own_part(fold(raw))
    digits = bool(_DIGIT.search(text))
    if digits:
        text = _REFERENCE.sub(" ", text)
    if "(" in text:
        text = _BRACKETS.sub(" ", text)
    text = text.strip()
    if text and not ((text[0].isalnum() or text[0] in "_([") and (text[-1].isalnum() or text[-1] in "_)].")):
        text = _LEAD.sub("", text)
    text = text.removeprefix("m/s ")
    pieces: list[str] = []
    if "." in text:
        for piece in text.split():
            m = _DOMAIN.match(piece)
            pieces.append(m[1] if m else piece)
        text = " ".join(pieces).replace(".", "")
    text = text.replace("'", "")
    if "  " in text or not text.replace(" ", "").isalnum():
        text = _NOT_WORD.sub(" ", text.replace("&", " and ").replace("+", " and ")).strip()
    tokens = text.split()
    ascii_ = text.isascii()
    if not ascii_ or 1 in map(len, tokens):
        tokens = _SPELT.sub(lambda m: m[1].replace(" ", "") if m[1].replace(" ", "") in _SPELT_FORMS else m[0], text).split()
    if not ascii_:
        tokens = [t for t in tokens if not _FOREIGN.search(t)]
    if digits or not ascii_:
        tokens = [t for t in tokens if not t.isdigit()]
    names: list[str] = []
    trade = given = parent = ""
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        i += 1
        kind, value = _kind(t)
        if kind == "name" and indic:
            if got := _TRADE_SOUND.get(sound(t)):
                kind, value = "trade", got
            elif got := _GIVEN_SOUND.get(sound(t)):
                kind, value = "given", got
        if not trade and i < n and (kind == "name" or kind == "trade") and len(t) + len(tokens[i]) >= 5:
            joined = t + tokens[i]
            plain = len(t) > 2 and len(tokens[i]) > 2 and len(joined) > 6 and t[:3] not in _TRADE_3[0] and tokens[i][-3:] not in _TRADE_3[1]
            got = None if plain else _TRADE.find(joined) if value != joined and len(value) != len(t) or kind == "name" else None
            if got and abs(len(got) - len(joined)) <= 1 and _kind(tokens[i])[0] in ("name", "legal", "drop", "trade"):
                kind, value = "trade", got
                i += 1
        if kind == "trade" and trade and len(t) < 5:
            continue
        if kind == "trade":
            trade = trade or value
            tails = TRADE_TAILS.get(value, ())
            if i < n and tails and (tokens[i].translate(DIGIT_LETTERS) in tails or (indic and sound(tokens[i]) in {sound(x) for x in tails}) or any(len(tokens[i]) in (3, 4, 5) and set(tokens[i]) <= set(x) for x in tails)):
                i += 1
        elif kind == "parent":
            parent = value
        elif kind in ("given", "given?"):
            if kind == "given" or not names:
                given = given or value
            else:
                names.append(t)
        elif kind == "name":
            if len(t) == 1:
                if i < n and tokens[i] in ("pierre", "claire"):
                    given = t
                elif not names and not given:
                    given = t
                elif names or given:
                    continue
            elif t in ("jean", "marie") and i < n and tokens[i] in ("pierre", "claire"):
                given = t + tokens[i]
                i += 1
            elif t in ("pierre", "claire") and len(given) == 1:
                given = {"pierre": "jeanpierre", "claire": "marieclaire"}[t]
            else:
                names.append(value)
    if not trade and names:
        for k, w in enumerate(names):
            rest, got = _cut_trade(w)
            if got:
                names[k], trade = rest, got
                break
        else:
            if len(names) > 1:
                rest, got = _cut_trade("".join(names))
                if got:
                    names, trade = [rest], got
    if names and not given:
        for k in range(min(13, len(names[0]) - 8), 4, -1):
            if (got := _GIVEN.words.get(names[0][:k])) and len(got) == k and len(names[0]) >= k + 8:
                given, names[0] = got, names[0][k:]
                break
    return Name("".join(names), " ".join(names), _SAME_TRADE.get(trade, trade), given, parent)


def same_given(a: str, b: str) -> bool:
    """Given names do not contradict each other: one is absent, an initial of the other, or the same."""
    return not a or not b or a == b or (min(len(a), len(b)) == 1 and a[0] == b[0])
