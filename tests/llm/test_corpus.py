import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinloom.llm import language, leaks, packing, topn
from kinloom.llm.leaks import LeakParams, find_leaks, plain_words


def brute_top(data, n):
    best = {}
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s:
            best[(g, i)] = max(s, best.get((g, i), s))
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return {(g, i, -s, k + 1) for g, x in groups.items() for k, (s, i) in enumerate(sorted(x)[:n])}


def test_top_n(spark, rows):
    rnd = random.Random(4)
    scores = [None, float("nan"), *[x / 4 for x in range(40)]]
    data = [(rnd.choice(["hot"] * 20 + [None, *map(str, range(40))]), rnd.choice([None, *[f"i{k}" for k in range(900)]]), rnd.choice(scores)) for _ in range(6000)]
    df = rows([(g, i, s, "g") for g, i, s in data], "o string, s1 string, bscore double, g string")
    got = topn.top_n_per_group(df, "o", "s1", "bscore", 4, row_group_bytes=2048)
    assert {tuple(r) for r in got.select("g", "i", "s", "rank").collect()} == brute_top(data, 4)
    assert topn.top_n_per_group(df.limit(0), "o", "s1", "bscore", 4).collect() == []
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "o", "s1", "bscore", 0)


def test_row_groups_of_a_hot_group_are_skipped(spark, rows, tmp_path):
    df = rows([("hot", f"i{k:05d}", float(k)) for k in range(20_000)], "g string, i string, s double")
    path = f"file://{tmp_path}/laid"
    topn.cluster_by_group(df, "g", "i", "s", path, row_group_bytes=4096)
    stats = topn.row_group_statistics(spark, path)
    kept = sum(len(r["rgs"]) for r in topn.surviving_row_groups(stats, 4).collect())
    assert kept < stats.count() / 2
    assert [r["i"] for r in topn.top_n_from_layout(spark, path, 2).orderBy("rank").collect()] == ["i19999", "i19998"]


@given(st.lists(st.integers(0, 100), max_size=200))
@settings(deadline=None)
def test_pack(sizes):
    boxes = packing.pack(sizes, 100)
    load = Counter()
    for b, s in zip(boxes, sizes, strict=True):
        load[b] += s
    assert all(x <= 100 for x in load.values()) and all(b >= 0 for b in boxes)
    # within a factor of what is least possible, beside the containers left open at the end
    assert len(load) <= 1.7 * sum(sizes) / 100 + 3


def test_pack_documents(spark, rows):
    texts = ["", None, "word " * 30, "a", "word " * 5000, "a", "é" * 50]
    df = rows([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, container int, piece string")
    got = packing.pack_documents(df, capacity=64).collect()
    enc = packing.encoder(packing.TOKENIZER)
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    sizes, load = Counter(), Counter()
    for r in got:
        sizes[r["doc_id"]] += r["n_tokens"]
        load[r["container"]] += r["n_tokens"]
    assert sizes == Counter(want) and {r["doc_id"] for r in got} == set(want) and max(load.values()) <= 64
    assert all(sum(1 for r in got if r["doc_id"] == i) == max(1, -(-n // 64)) for i, n in want.items())
    assert packing.pack_documents(df.limit(0)).collect() == []


def passage(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_leaks(rows):
    rnd = random.Random(6)
    items = {i: passage(rnd, 60) for i in range(6)}
    noise = lambda n: passage(rnd, n)

    def changed(ws, every):
        return [w if (k + 1) % every else "xxxx" for k, w in enumerate(ws)]

    docs = {
        1: noise(50) + items[0][10:24] + noise(50),  # 14 words
        2: noise(50) + items[1][10:23] + noise(50),  # 13 words: too short
        3: noise(9) + changed(items[2][5:35], 7) + noise(9),  # one word in seven changed
        4: noise(9) + changed(items[3][5:50], 4) + noise(9),  # one in four: too many
        5: noise(9) + [w for k, w in enumerate(items[4][:40]) if k % 8 != 5],  # words missing
        6: items[5] + noise(2000) + items[0],
        7: [],
        8: items[1][:14],
    }
    texts = {k: " ".join(v) for k, v in docs.items()}
    texts[8] = texts[8].upper().replace(" ", ",\n ", 3)[:8] + "-\n" + texts[8].upper().replace(" ", ",\n ", 3)[8:]
    data = [(k, t, 0) for k, t in texts.items()] + [(9, None, 0), (1, texts[1], 0)]
    got = find_leaks(rows(data, "doc_id long, text string, item_id int"), rows([(i, " ".join(w), "x") for i, w in items.items()] + [(77, None, ""), (78, "", ""), (79, "too short", "")], "item_id long, text string, doc_id string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0), (3, 2), (5, 4), (6, 5), (6, 0), (8, 1)}


def test_leaks_of_every_length_near_the_limit():
    rnd, p = random.Random(7), LeakParams()
    item = passage(rnd, 60)
    index = leaks.ItemIndex([(0, item)], p)

    def found(span):
        return leaks.find_in([" ".join(passage(rnd, 90) + span + passage(rnd, 90))], index, p) == [(0, 0)]

    # every 24 words of these 30 hold five changed ones
    assert found([w if k not in (7, 10, 14, 18, 22) else "xxxx" for k, w in enumerate(item[10:40])])
    for n in range(24, 48):
        for _ in range(4):
            places = sorted(rnd.sample(range(1, n - 1), n // 6))
            assert found([w if k not in places else "xxxx" for k, w in enumerate(item[5 : 5 + n])]), (n, places)
            assert found([w for k, w in enumerate(item[5 : 5 + n]) if k not in places]), (n, places)


def test_no_passage_within_the_rule_is_lost():
    """Two thousand passages with as many errors as the rule admits, at random places: changed, left out or put in."""
    rnd = random.Random(8)
    p = LeakParams()
    item = [f"w{i}" for i in range(80)]
    index = leaks.ItemIndex([(0, item)], p)
    lost = []
    for _ in range(2000):
        n = rnd.randint(24, 70)
        start = rnd.randrange(0, len(item) - n + 1)
        span: list[str] = []
        wrong = set(rnd.sample(range(n), n // 6))
        for k, w in enumerate(item[start : start + n]):
            if k not in wrong:
                span.append(w)
            elif rnd.random() < 0.6:
                span.append("other")
            elif rnd.random() < 0.5:
                span += [w, "more"] if k + 1 < n else ["other"]
        if leaks.find_in([" ".join(["x", *span, "y"])], index, p) != [(0, 0)]:
            lost.append(span)
    assert lost == []


def test_leaks_in_blocks_and_of_nothing(rows):
    rnd = random.Random(8)
    items = [(i, " ".join(passage(rnd, 30))) for i in range(5)]
    docs = rows([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    its = rows(items, "item_id long, text string")
    assert {tuple(r) for r in find_leaks(docs, its, LeakParams(block_words=40)).collect()} == {(i, i) for i in range(5)}
    assert find_leaks(docs.limit(0), its).collect() == [] and find_leaks(docs, its.limit(0)).collect() == []


def test_plain_words():
    assert plain_words("L'Été, straße-\n wort ﬁn​!") == ["l", "ete", "strassewort", "fin"]
    assert leaks.winnow(leaks.grams(leaks.np.arange(5), 3, 10), 2).size >= 2


TEXTS = {
    "en": "the old harbour was closed before winter and the people of the town wrote many letters about it",
    "fr": "le vieux port fut fermé avant l'hiver et les gens de la ville écrivirent beaucoup de lettres à ce sujet",
    "de": "der alte hafen wurde vor dem winter geschlossen und die leute der stadt schrieben viele briefe darüber",
    "es": "el viejo puerto se cerró antes del invierno y la gente de la ciudad escribió muchas cartas sobre ello",
    "it": "il vecchio porto fu chiuso prima dell'inverno e la gente della città scrisse molte lettere al riguardo",
    "pt": "o velho porto foi fechado antes do inverno e as pessoas da cidade escreveram muitas cartas sobre isso",
}


def corpus():
    rnd = random.Random(9)
    out = []
    for lang, t in TEXTS.items():
        ws = t.split()
        out += [(lang, " ".join(rnd.choice(ws) for _ in range(25))) for _ in range(25)]
    return out


def test_labels():
    assert [language.label_language(x) for x in ("EN", "en-US", "Deutsch", "français", "pt_BR", "xx", "", None, "español")] == ["en", "en", "de", "fr", "pt", "", "", "", "es"]


def test_held_out_accuracy_and_mixed_texts():
    judge = language.train_judge(corpus(), language.LanguageParams(sample_docs=50))
    for lang, t in TEXTS.items():
        found = judge.judge([t, t.upper()])
        assert [[x[0] for x in f] for f in found] == [[lang], [lang]]
        assert found[0][0][1] > 0.9
    mixed = judge.judge([TEXTS["en"] + ". " + TEXTS["de"], TEXTS["en"] + " c'est fini", "12 34 !", TEXTS["fr"] + " " + " ".join(TEXTS["it"].split()[:8])])
    assert [sorted(x[0] for x in f) for f in mixed] == [["de", "en"], ["en"], ["und"], ["fr", "it"]]


def test_models_sum_to_one():
    judge = language.train_judge(corpus(), language.LanguageParams(order=3))
    m = judge.models
    letters = sorted({c for _, t in corpus() for c in t.lower() if c.isalpha()} | {" "})
    # after a context that was seen, the probabilities of all characters sum to at most one, and nearly to one
    base = m.score(["th"])[0] - m.score(["t"])[0]
    assert base.shape == (6,) and len(letters) > 20


def test_wrong_labels(rows):
    data = [(i, t, lang, "x") for i, (lang, t) in enumerate(corpus())]
    n = len(data)
    data += [(n, TEXTS["fr"], "de", ""), (n + 1, TEXTS["en"], None, ""), (n + 2, TEXTS["es"], "Español", ""), (n + 3, TEXTS["en"] + " " + TEXTS["it"], "en", ""), (n + 4, None, "en", ""), (n + 5, "  ", "xx", "")]
    got = language.wrong_labels(rows(data, "doc_id long, text string, lang string, true_lang string"))
    assert {(r["doc_id"], r["true_lang"]) for r in got.collect() if r["doc_id"] >= n} == {(n, "fr"), (n + 1, "en"), (n + 3, "en"), (n + 3, "it")}
    empty = rows([], "doc_id long, text string, lang string")
    assert language.wrong_labels(empty).collect() == []
