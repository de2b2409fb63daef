"""Reading postal addresses of the United States, India and France into components."""

from __future__ import annotations

import re
from typing import NamedTuple

from kinloom.functions.lexicon import STATES as STATE_CODES
from kinloom.llm.words import DIGIT_LETTERS, any_of, fold

# Kinds of street and their written forms.
STREET_KINDS = {
    "road": "rd", "street": "st str", "avenue": "ave av", "boulevard": "blvd bd bld boul", "drive": "dr drv", "lane": "ln", "court": "ct", "parkway": "pkwy pky",
    "terrace": "ter terr", "highway": "hwy", "circle": "cir", "square": "sq", "marg": "mrg", "cross": "crs", "bazaar": "bazar bzr", "main road": "main",
    "rue": "r", "place": "pl", "route": "rte", "chemin": "che ch chem", "allee": "all", "impasse": "imp", "quai": "", "cours": "",
}
FRENCH_KINDS = {"rue", "place", "route", "chemin", "allee", "impasse", "quai", "cours", "avenue", "boulevard"}
# Compass parts.
COMPASS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
# Particles between the kind of a French street and its name.
PARTICLES = {"de", "du", "des", "la", "le", "les", "l", "d", "aux", "au"}
# The departments of France as folded words, but for Paris, which is a town.
DEPARTMENTS = """ain, aisne, allier, alpes de haute provence, hautes alpes, alpes maritimes, ardeche, ardennes, ariege, aube, aude, aveyron, bouches du rhone, calvados, cantal, charente,
charente maritime, cher, correze, corse du sud, haute corse, cote d or, cotes d armor, creuse, dordogne, doubs, drome, eure, eure et loir, finistere, gard, haute garonne, gers, gironde,
herault, ille et vilaine, indre, indre et loire, isere, jura, landes, loir et cher, loire, haute loire, loire atlantique, loiret, lot, lot et garonne, lozere, maine et loire, manche, marne,
haute marne, mayenne, meurthe et moselle, meuse, morbihan, moselle, nievre, nord, oise, orne, pas de calais, puy de dome, pyrenees atlantiques, hautes pyrenees, pyrenees orientales, bas rhin,
haut rhin, rhone, haute saone, saone et loire, sarthe, savoie, haute savoie, seine maritime, seine et marne, yvelines, deux sevres, somme, tarn, tarn et garonne, var, vaucluse, vendee,
vienne, haute vienne, vosges, yonne, territoire de belfort, essonne, hauts de seine, seine saint denis, val de marne, val d oise, guadeloupe, martinique, guyane, reunion, mayotte"""
_TAIL_UNITS = r"(?:p\.?\s?o\.?\s*box|pmb|b\.?p\.?|box|suite|ste|unit|apt|apartment|appt|flat|office|bureau|room|rm|floor|fl|etage|bat|batiment|desk|shop floor)"
_UNIT = re.compile(
    rf"\b{_TAIL_UNITS}\b\.?\s*(?:no\b\.?\s*|#\s*)?(?:\d{{1,4}}\s?[a-z]?\b|[a-z]\b)(?:\-\d+\b)?|\b\d{{1,3}}(?:st|nd|rd|th|e|er|eme)\s+(?:floor|fl|etage)\b"
)
_LANDMARK = re.compile(
    r"\b(?:near|nr|behind|opp(?:osite)?|across from|next to|beside|face a[ux]?|derriere|pres d[eu]s?|a cote d[eu]s?)\b\.?\s*(?:(?:the|la|le|l)\b[\s']*)?"
    r"(?:[a-z]+\s+){0,2}?(?:pond|depot|hall|stand|office|tank|mairie|marche|gare|school|temple|church|station|bank|park|eglise|ecole)\b"
)
_LANDMARK_REST = re.compile(r"\b(?:near|behind|opp(?:osite)?|across from|next to|face a[ux]?|derriere|pres d[eu]s?|a cote d[eu]s?)\b[^,;\-]*")
#: Words of which a text with a landmark, a unit or the name of a state has one at least: they spare most texts the patterns.
_BESIDE = set("near nr next behind beside opp opposite across face derriere pres cote".split())
_UNITS = set("box obox pobox pmb bp b suite ste unit apt apartment appt flat office bureau room rm floor fl etage bat batiment desk".split())
_LETTERS = re.compile("[a-z]+")
_NUMBER_WORD = re.compile(r"(?:\b(?:h|s|d|door|plot|shop|house|flat|survey|ph)\b[\s.]*)?\bn[o0]s?\b[\s.:]*(?=\d)|#\s*(?=\d)")
#: Dashes that part components, as commas do.
_DASH = re.compile(r"(?<=\s)[-–—]+(?=\s)|[–—]")
_WORD = re.compile(r"[a-z0-9]+")
# (these begin with a digit, for which a text is searched fast; what stands before it is looked at then)
_SPAN = re.compile(r"(\d(?<!\d\d)\d{0,4})\s?-\s?(\d{1,5})(?!\d)")
_NUMBER = re.compile(r"(\d(?<!\w\d)\d{0,4})[a-z]?(?![\w])")
_MARKED = re.compile(r"(\d+)[a-z]?(?:\s?-\s?\d+)?(?![\d])")
_ZIP = {
    "US": re.compile(r"(\d(?<![\d#]\d)\d{4})(?:-\d{4})?(?!\d)"),
    "India": re.compile(r"(\d(?<!\d\d)\d{2}) ?(\d{3})(?!\d)"),
    "France": re.compile(r"(\d(?<!\d\d)\d{4})(?!\d)"),
}
_TOWN_TAIL = {"city", "dist", "district", "cedex", "town"}
_KINDS = {w: k for k, short in STREET_KINDS.items() for w in [k, *short.split()] if " " not in w}


def _state_rules(country: str) -> tuple[re.Pattern | None, dict[str, str], set[str]]:
    codes = dict(STATE_CODES.get(country, {}))
    if not codes:
        return None, {}, set()
    # romanised names have lost a silent last vowel
    codes |= {w[:-1]: c for w, c in codes.items() if country == "India" and w.endswith("a")}
    return re.compile(rf"\b{any_of(codes)}\b"), codes, {_LETTERS.match(w)[0] for w in codes}


_RULES = {c: _state_rules(c) for c in _ZIP}
_CODES = {c: set(_RULES[c][1].values()) for c in _ZIP}
_REGIONS = {x.strip() for x in DEPARTMENTS.replace("\n", " ").split(",")}
_LONGEST_REGION = max(x.count(" ") + 1 for x in _REGIONS)


class Address(NamedTuple):
    number: str = ""
    compass: str = ""
    street: str = ""  # own words of the street with spaces, without kind and particles
    kind: str = ""
    town: str = ""
    state: str = ""
    postcode: str = ""
    unit: str = ""


BLANK = Address()


_MIXED = re.compile(r"[a-z][0-9]|[0-9][a-z]")


def _words(text: str, mixed: bool) -> list[str]:
    """The words of a part of a text; ``mixed`` tells whether the text has digits beside letters."""
    if not mixed:
        return _WORD.findall(text)
    return [w.translate(DIGIT_LETTERS) if not w.isdigit() and any(c.isdigit() for c in w) and sum(c.isalpha() for c in w) > 2 else w for w in _WORD.findall(text)]


def _street_and_town(words: list[str], town_elsewhere: bool) -> tuple[list[str], list[str]]:
    """Own words of a French street, and what follows it where nothing but its place tells it from the town."""
    if town_elsewhere:
        for k in range(min(_LONGEST_REGION, len(words) - 1), 0, -1):
            if " ".join(words[-k:]) in _REGIONS:
                return [w for w in words[:-k] if w not in PARTICLES] or words[:-k], words[-k:]
        return [w for w in words if w not in PARTICLES] or words, []
    return words[:1], words[1:]


def read_address(raw: str | None, country: str | None) -> Address:
    """Reads an address as typed. NULL and blank give an address of empty parts; unknown countries are read by the US rules."""
    if not raw or raw.isspace():
        return BLANK
    country = country if country in _ZIP else "US"
    text = " ".join(fold(raw).split())
    has = set(_LETTERS.findall(text))
    if not has.isdisjoint(_BESIDE):
        text = _LANDMARK_REST.sub(" ", _LANDMARK.sub(" ", text))
    unit = ""
    if not has.isdisjoint(_UNITS) and (m := _UNIT.search(text)):
        unit = " ".join(_WORD.findall(m[0]))
        text = _UNIT.sub(" ", text)
    # the house number, by its own mark if there is one
    number = ""
    if ("no" in text or "#" in text or "n0" in text) and (marked := _NUMBER_WORD.search(text)):
        rest = text[marked.end() :]
        m = _MARKED.match(rest)
        if m:
            number = m[1]
            text = text[: marked.start()] + " \x01 " + rest[m.end() :]
    postcode = ""
    found = list(_ZIP[country].finditer(text))
    if found:
        m = found[-1]
        postcode = "".join(g for g in m.groups() if g)
        text = text[: m.start()] + " , " + text[m.end() :]
    if not number:
        m = ("-" in text and _SPAN.search(text)) or _NUMBER.search(text)
        if m:
            number = m[1]
            text = text[: m.start()] + " \x01 " + text[m.end() :]
    number = number.lstrip("0") or number
    state = ""
    pattern, codes, first = _RULES[country]
    if pattern and not has.isdisjoint(first):
        hits = list(pattern.finditer(text))
        if hits:
            state = codes[hits[-1][0]]
            text = text[: hits[-1].start()] + " , " + text[hits[-1].end() :]
    if "-" in text or not text.isascii():
        text = _DASH.sub(",", text)
    mixed = bool(_MIXED.search(text))
    comps: list[list[str]] = []
    at = -1
    for p in text.replace(";", ",").replace("|", ",").split(","):
        if not p or p.isspace():
            continue
        left, mark, right = p.partition("\x01")
        if not mark:
            comps.append(_words(p, mixed))
        elif not right or right.isspace():
            comps.append([*_words(left, mixed), "\x01"])
            at = len(comps) - 1
        else:
            if lw := _words(left, mixed):
                comps.append(lw)
            comps.append(["\x01", *_words(right, mixed)])
            at = len(comps) - 1
    if not state and pattern:
        for c in reversed(comps):
            if c and c[-1] in _CODES[country] and (len(comps) > 1 or len(c) > 2) and not (len(c) > 1 and c[0] == "\x01" and len(c) <= 3 and c[-1] in _KINDS):
                state = c.pop()
                break
    comps_clean: list[list[str]] = []
    street_at, alone = -1, True
    for k, c in enumerate(comps):
        if k == at:
            words = [w for w in c if w != "\x01"]
            alone = not words
            street_at = len(comps_clean)
            if words:
                comps_clean.append(words)
        elif c:
            comps_clean.append(c)
    comps = comps_clean

    def kinded(c: list[str]) -> bool:
        return any(w in _KINDS and (len(w) > 1 or i == 0) for i, w in enumerate(c)) and len(c) > 1

    def elsewhere(at: int) -> bool:
        """Whether another component can be the town."""
        return any(k != at and any(w.isalpha() and len(w) > 1 for w in c) and " ".join(c) not in _REGIONS for k, c in enumerate(comps))

    if street_at >= len(comps) or street_at < 0 or (not kinded(comps[street_at]) and len(comps) > 1):
        # the number stood alone, or nowhere: the component with a kind of street is the street
        order = sorted(range(len(comps)), key=lambda k: (abs(k - max(street_at, 0) + 0.1)))
        led = next((k for k in order if comps[k][0] in PARTICLES), min(max(street_at - (country == "France" and alone), 0), len(comps) - 1) if comps else -1)
        street_at = next((k for k in order if kinded(comps[k])), led)
    if street_at < 0 or not comps:
        return Address(number=number, state=state, postcode=postcode, unit=unit)
    words = comps[street_at]
    compass = kind = ""
    street: list[str] = []
    rest: list[str] = []
    i, n = 0, len(words)
    if n > 1 and country == "France":
        lead = next((k for k, w in enumerate(words) if w in _KINDS and _KINDS[w] in FRENCH_KINDS), -1)
        if lead == 0 or (lead > 0 and lead < n - 1):
            before = words[:lead]
            kind = _KINDS[words[lead]]
            i = lead + 1
            while i < n and words[i] in PARTICLES:
                i += 1
            street, rest = _street_and_town(words[i:], elsewhere(street_at))
            rest = [*before, *rest]
        else:
            while i < n - 1 and words[i] in PARTICLES:
                i += 1
            street, rest = _street_and_town(words[i:], elsewhere(street_at))
    else:
        if i < n - 1 and words[i] in COMPASS:
            compass = COMPASS[words[i]]
            i += 1
        end = next((k for k in range(i + 1, n) if words[k] in _KINDS and len(words[k]) > 1), -1)
        if end > 0 and end - i <= 4:
            street = words[i:end]
            kind = _KINDS[words[end]]
            end += 1
            if kind == "main road" and end < n and _KINDS.get(words[end]) == "road":
                end += 1
            rest = words[end:]
            if rest and rest[0] in COMPASS and not compass:
                compass, rest = COMPASS[rest[0]], rest[1:]
        elif i < n:
            street, rest = [words[i]], words[i + 1 :]
            if rest and rest[0] in COMPASS and not compass:
                compass, rest = COMPASS[rest[0]], rest[1:]
    towns = [c for k, c in enumerate(comps) if k != street_at]
    if len(rest) > 1 and rest[0] in _CODES[country]:
        state, rest = state or rest[0], rest[1:]
    if rest:
        towns.insert(0, rest)
    named: list[list[str]] = []
    for c in towns:
        c = [w for w in c if w != "\x01"]
        while len(c) > 1 and c[-1] in _TOWN_TAIL:
            c.pop()
        if not c or all(w.isdigit() for w in c):
            continue
        if len(c) == 1 and (c[0] in COMPASS or c[0] in _CODES[country] or c[0] in PARTICLES or len(c[0]) < 2):
            if c[0] in COMPASS and not compass and country != "France":
                compass = COMPASS[c[0]]
            elif c[0] in _CODES[country] and not state:
                state = c[0]
            continue
        named.append(c)
    town = ""
    if named:
        if country == "France":
            own = [c for c in named if " ".join(c) not in _REGIONS]
            state = state or next((" ".join(c) for c in named if " ".join(c) in _REGIONS), "")
            if own:
                for k in range(min(_LONGEST_REGION, len(own[0]) - 1), 0, -1):
                    if (tail := " ".join(own[0][-k:])) in _REGIONS:
                        state, own[0] = state or tail, own[0][:-k]
                        break
            town = "".join(own[0]) if own else ""
        else:
            town = "".join(named[0])
    return Address(number, compass, " ".join(street), kind, town, state, postcode, unit)
