import random
import re

from kinloom.llm import premises
from kinloom.llm.labelmodel import link_entities
from kinloom.llm.premises import same_premises
from kinloom.llm.words import Lexicon, any_of, osa

DDL = "entity_id string, business_address string, country string"


def found(rows, left, right):
    return sorted(tuple(r) for r in same_premises(rows(left, DDL), rows(right, DDL)).collect())


def test_a_street_written_where_the_town_stands_is_met(rows):
    left = [("S1a", "3138 Avenue Donjereul, 29627 Vedove-les-Pres", "France"), ("S1b", "12 Rue Lonfomac, 33338 Gesuniville", "France")]
    right = [("S2a", "29627 Veodve-les-Pres,3138, Donjereul", "France"), ("S2b", "29627 Vedove-les-Pres, 3139, Donjereul", "France")]
    assert found(rows, left, right) == [("S1a", "S2a")]


def test_large_cells_meet_by_tokens(rows, monkeypatch):
    rnd = random.Random(4)
    streets = ["".join(rnd.choice("abcdefg") for _ in range(9)) for _ in range(12)]

    def some(mark):
        ends = [", Kilweffield 41958", ", 41958", ", Kilweffield", ", Nosuchtown"]
        return [(f"{mark}{k}", f"{rnd.choice('12')} {rnd.choice(streets)} {rnd.choice(['Rd', 'Road', 'Lane'])}{rnd.choice(ends)}", "US") for k in range(40)]

    left, right = some("S1"), some("S2")
    want = found(rows, left, right)
    assert len(want) > 20 and len(set(want)) == len(want)
    monkeypatch.setattr(premises, "CELL", 0)
    assert found(rows, left, right) == want


def test_any_of_takes_the_longest_word():
    words = ["virginia", "west virginia", "delhi", "new delhi", "go", "goa", "a.b"]
    for text in ("in west virginia now", "new delhi", "goa go", "a.b", "axb", "gob", "west virgini"):
        want = [m[0] for m in re.finditer(r"\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")\b", text)]
        assert [m[0] for m in re.finditer(rf"\b{any_of(words)}\b", text)] == want


def test_lexicon_misses_no_word_within_one_edit():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(4, 10))) for _ in range(40)]
    lexicon = Lexicon({w: w for w in words}, 5)
    for _ in range(4000):
        t = list(rnd.choice(words))
        i = rnd.randrange(len(t))
        t = "".join(t[:i] + rnd.choice([[], [t[i], rnd.choice("abc")], [rnd.choice("abc")], t[i : i + 2][::-1]]) + t[i + rnd.choice([1, 1, 2]) :])
        near = [(n, w) for w in words if len(w) >= 5 and len(t) >= 4 and (n := osa(t, w, 1)) <= 1]
        assert lexicon.find(t) == (t if t in words else min(near)[1] if near else None)


def test_a_copy_with_its_street_where_the_town_stands_is_linked(rows):
    ddl = "entity_id string, business_name string, business_address string, country string"
    left = [("S1a", "Zanfrelo Bakery SAS", "3138 Avenue Donjereul, 29627 Vedove-les-Pres", "France"), ("S1b", "Zanfrelo Bakery SAS", "12 Rue Lonfomac, 33338 Gesuniville", "France")]
    right = [("S2a", "zanfrelo bakery", "29627 Veodve-les-Pres,3138, Donjereul", "France"), ("S2b", "Zanfrelo Bakery", "12 Rue Lonfomac, 33338 Gesuniville", "France")]
    got = link_entities(rows(left, ddl), rows(right, ddl)).select("s1", "o").collect()
    assert sorted(tuple(r) for r in got) == [("S1a", "S2a"), ("S1b", "S2b")]
