import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from kinloom.llm import forms

CASES = {
    "Ｋｏｔｉ　Foods": "Koti Foods",
    "Kewirra Мinmirsо": "Kewirra Minmirso",
    "café": "café",
    "a​b­c️": "abc",
    "1141 Elm St": "1141 Elm St",
    "Lⅰⅴalac ﬁn": "Livalac fin",
    "№ 7": "No 7",
    "Elm ΟΗ 13848": "Elm OH 13848",
    "Ꭺcme ꓐank": "Acme Bank",
    "\U0001d400cme \U0001d5d5ank": "Acme Bank",
    "ᴀᴄᴍᴇ": "acme",
    "\U0001f130cme\u20dd": "Acme",
    "a\U000e0061b": "ab",
}
PLAIN = ["КАССА", "ТОРТ", "оса", "Foods КАССА МЕБЕЛЬ", "ᏣᎳᎩ", "ΟΗ ΚΑΙ", "", "  two  spaces ", "élève", "Жемчуг МЕБЕЛЬ", "Θάλασσα", "東京堂", "さくら", "नोचोला", "مكتبة", "Çarşı Łąka", "pl0gornen", "Größe", "x" * 100_000]


def test_cases():
    for text, want in CASES.items():
        assert forms.ordinary(text) == want


def test_ordinary_text_stays():
    for text in PLAIN:
        assert forms.ordinary(text) == text


@given(st.text(max_size=30))
def test_a_second_pass_changes_nothing(text):
    once = forms.ordinary(text)
    assert forms.ordinary(once) == once


@given(st.text(alphabet="abcdeé ", max_size=20))
def test_decomposed_text_becomes_composed(text):
    assert forms.ordinary(unicodedata.normalize("NFD", text)) == unicodedata.normalize("NFC", text)


def test_mapping_is_final():
    mapping = forms.compile_mapping()
    assert len(mapping) > 1000
    assert not any(c in mapping for v in mapping.values() for c in v)


def test_find_disguised(rows):
    schema = "entity_id string, business_name string, business_address string, form string, value int"
    t = rows([("a", "Ａb", "plain", "x", 1), ("a", "Ａb", "plain", "x", 1), ("b", None, "x y", None, None), ("c", "", "", "", 0), ("d", "é", None, "", 0)], schema)
    assert sorted(map(tuple, forms.find_disguised([t, t]).collect())) == [("a", "business_name"), ("b", "business_address")]
    assert forms.find_disguised([t.limit(0)]).collect() == []
    unified = forms.unify_forms(forms.long_fields([t]).distinct()).filter("entity_id = 'b'").collect()
    assert {(r["field_name"], r["form"], r["is_case"]) for r in unified} == {("business_name", None, False), ("business_address", "x y", True)}
