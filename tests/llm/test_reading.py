from kinloom.llm import words
from kinloom.llm.names import read_name


def test_words_like_no_listed_word_cost_no_neighbourhood(monkeypatch):
    asked = []
    whole = words.deletions
    monkeypatch.setattr(words, "deletions", lambda w: asked.append(w) or whole(w))
    # both begin like a trade, three letters of it
    assert read_name("Pharkovaner Cerakomiflo") == ("pharkovanercerakomiflo", "pharkovaner cerakomiflo", "", "", "")
    assert asked == []
    assert read_name("Pharkovaner Ceramcis").trade == "ceramics" and asked


def test_marks_go_and_words_of_other_scripts_stay_apart():
    assert words.fold("Žlutý Bát œuvre ÉTÉ") == "zluty bat oeuvre ete"
    assert words.fold("रिशेरा तवमा") == " ".join(words.fold(w) for w in ("रिशेरा", "तवमा"))
    # marks that stay have the order of the whole text
    assert words.fold("éְֱé") == words.fold("éְֱé") == "eְֱe"
