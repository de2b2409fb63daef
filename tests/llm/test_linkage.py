import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm.addresses import read_address
from kinloom.llm.labelmodel import fit_label_model, link_entities
from kinloom.llm.metric import RadiusParams, pairs_within, radius_join, within
from kinloom.llm.names import read_name
from kinloom.llm.organisations import learn_words, record_pairs, same_organisation
from kinloom.llm.premises import assign, likeness, same_premises, token_keys
from kinloom.llm.records import expand_pairs, read_records
from kinloom.llm.words import deletions, osa


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != y)))
        d = row
    return d[-1]


def words(rnd, n, low=4, high=12):
    return ["".join(rnd.choice("abcde") for _ in range(rnd.randint(low, high))) for _ in range(n)]


def test_pairs_within_are_those_of_the_true_distance():
    rnd = random.Random(1)
    left = ["".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 3, 6, 12, 33, 40, 63, 64, 70]))) for _ in range(120)]
    right = left[:60] + [w[:2] + "x" + w[3:] for w in left[:40]] + [w[1:] + "zz" for w in left[:40]] + ["y" * 5000]
    params = RadiusParams(radius=3, short=((7, 1), (10, 2)))
    i, j, d = pairs_within(left, right, params)
    limit = lambda n: 1 if n < 7 else 2 if n < 10 else 3
    want = {(a, b, lev(x, y)) for a, x in enumerate(left) for b, y in enumerate(right) if len(y) < 100 and lev(x, y) <= limit(min(len(x), len(y)))}
    assert set(zip(i.tolist(), j.tolist(), d.tolist())) == want and len(i) == len(want)
    assert within("a" * 5000, "a" * 4999 + "b", 3) == 1 and within("abc", "xyz", 2) == 3


def joined(rows, left, right, params):
    ddl = "block string, text string, id bigint, tag string"
    sides = [rows([(b, t, k, f"{side}{k}") for k, (b, t) in enumerate(x)], ddl) for side, x in (("l", left), ("r", right))]
    return [tuple(r) for r in radius_join(*sides, params).collect()]


def test_radius_join_is_exact_through_cells_of_cells(rows):
    rnd = random.Random(2)
    left = [(rnd.choice("xy"), w) for w in words(rnd, 700)] + [("x", ""), (None, "abc"), ("x", None), ("x", "a" * 500), ("x", "a" * 121)]
    right = [(rnd.choice("xyz"), w) for w in words(rnd, 300)] + [("x", "b" * 5000), ("x", ""), ("x", "a" * 120), ("x", "a" * 499)]
    params = RadiusParams(radius=2, cell_rows=10, pivots=4, pack_rows=50, broadcast_pivots=5)
    got = joined(rows, left, right, params)
    want = set()
    for i, (b, t) in enumerate(left):
        for j, (c, u) in enumerate(right):
            if b and t and u and b == c and abs(len(t) - len(u)) <= 2 and (d := within(t, u, 2)) <= 2:
                want.add((i, j, f"l{i}", f"r{j}", d))
    assert set(got) == want and len(got) == len(want) and any(r[3] == "r303" for r in got)


def test_radius_join_at_full_size_against_a_stated_query_set(rows):
    """20,000 names in one block with production parameters; every id divisible by 100 is compared with all of the other side."""
    rnd = random.Random(6)
    syllables = [a + b for a in "bcdfgklmnprstv" for b in "aeiou"]
    left = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(4, 8))) for _ in range(20_000)]
    right = []
    for w in left[:10_000]:
        v = list(w)
        for _ in range(rnd.randint(0, 4)):
            v[rnd.randrange(len(v))] = rnd.choice("abcdefgh")
        right.append("".join(v))
    got = {(r[0], r[1]) for r in joined(rows, [("b", t) for t in left], [("b", t) for t in right], RadiusParams())}
    for j in range(0, len(right), 100):
        assert {i for i, k in got if k == j} == {i for i, t in enumerate(left) if within(t, right[j], 3) <= 3}


def test_radius_join_of_nothing(rows):
    assert joined(rows, [("x", "abc")], [], RadiusParams()) == [] and joined(rows, [], [("x", "abc")], RadiusParams()) == []


def test_osa_and_deletions():
    assert osa("ab", "ba", 2) == 1 and osa("abc", "xyz", 2) == 3 and osa("abc", "abc", 0) == 0
    assert deletions("abc") == {"abc", "ab", "ac", "bc"}


@pytest.mark.parametrize(
    ("raw", "core", "trade", "given", "parent"),
    [
        ("James Clenworan & Stanmilax Transport Corp", "clenworanstanmilax", "transport", "james", ""),
        ("Mr5 TenerdoxKinmurdax Rlty Co", "tenerdoxkinmurdax", "realty", "", ""),
        ("वोवजि तेदतु देन्तल करे", "vovajitedatu", "dental", "", ""),
        ("trealdontenguvixinsuance.us", "trealdontenguvix", "insurance", "", ""),
        ("Grolagix Clonzagan Mfg d/b/a Hanrervin Fetirse Uphol", "hanrervinfetirse", "upholstery", "", ""),
        ("Gubuha Mobuke Staty (fka Hechudu Tichuvi Upholstery)", "gubuhamobuke", "stationery", "", ""),
        ("Susan Stirivin & Dramivin Ceramics Corp Group #47461", "stirivindramivin", "ceramics", "susan", "group"),
        ("The Company", "", "", "", ""),
        (None, "", "", "", ""),
        ("   ", "", "", "", ""),
    ],
)
def test_names(raw, core, trade, given, parent):
    n = read_name(raw)
    assert (n.core, n.trade, n.given, n.parent) == (core, trade, given, parent)


@pytest.mark.parametrize(
    ("raw", "country", "want"),
    [
        ("# 6197-6199 W Wirhubow Hwy - Harhenville - TX 85060-1234", "US", ("6197", "w", "wirhubow", "highway", "harhenville", "tx", "85060")),
        ("Harhenville, TX, 6197 Wirhubow Highway West, Ste 12", "US", ("6197", "w", "wirhubow", "highway", "harhenville", "tx", "")),
        ("H.No. 3010, Nirsiyam Main Rd, near water tank, Jarsopnagar, Rajasthan 363 222", "India", ("3010", "", "nirsiyam", "main road", "jarsopnagar", "rj", "363222")),
        ("Appt 81, 44 Av. de Puibevette, 33100 Gédeli-sur-Lune, Gironde", "France", ("44", "", "puibevette", "avenue", "gedelisurlune", "gironde", "33100")),
        ("12 rue Victor Hugo, 75011 Paris", "France", ("12", "", "victor hugo", "rue", "paris", "", "75011")),
        ("9 bd de la Mer Rouge près du marché, 56100 Lorient, Morbihan", "France", ("9", "", "mer rouge", "boulevard", "lorient", "morbihan", "56100")),
        ("40 Green Valley Rd, Dallas, TX 75001", "US", ("40", "", "green valley", "road", "dallas", "tx", "75001")),
        ("", "US", ("",) * 7),
        (None, None, ("",) * 7),
    ],
)
def test_addresses(raw, country, want):
    a = read_address(raw, country)
    assert (a.number, a.compass, a.street, a.kind, a.town, a.state, a.postcode) == want


def test_long_texts_are_read():
    assert read_name("x" * 200_000).core == "x" * 200_000
    assert read_address("1 " + "y" * 200_000 + " St", "US").number == "1"


def test_assignment_is_optimal():
    assert assign(["elmwood", "dallas"], ["dallas", "elmwood"]) == (2.0, (1, 0))
    rnd = random.Random(3)
    for _ in range(60):
        a, b = words(rnd, rnd.randint(1, 4), 4, 6), words(rnd, rnd.randint(1, 5), 4, 6)
        b[: len(a) // 2] = a[: len(a) // 2]
        small, large = sorted((a, b), key=len)
        best = max(sum(likeness(x, y) for x, y in zip(small, p)) for p in permutations(large, len(small)))
        total, at = assign(a, b)
        assert abs(total - best) < 1e-9 and abs(total - sum(likeness(a[i], b[j]) for i, j in enumerate(at) if j >= 0)) < 1e-9


def test_token_keys_miss_no_pair_within_two_edits(rows):
    rnd = random.Random(4)
    pairs = []
    for w in words(rnd, 400, 3, 11):
        v = list(w)
        for _ in range(rnd.randint(0, 2)):
            i, kind = rnd.randrange(len(v)), rnd.randrange(4)
            if kind == 0:
                v[i] = rnd.choice("abcdefg")
            elif kind == 1 and len(v) > 3:
                del v[i]
            elif kind == 2:
                v.insert(i, rnd.choice("abcdefg"))
            elif i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
        if likeness(w, "".join(v)):
            pairs.append((w, "".join(v)))
    got = rows(pairs, "a string, b string").select(F.arrays_overlap(F.array(*token_keys(F.col("a"))), F.array(*token_keys(F.col("b")))).alias("met")).collect()
    assert len(pairs) > 200 and all(r["met"] for r in got)


def test_premises_with_edits_order_and_shared_postcodes(rows):
    at = lambda *xs: rows([(f"{'S1' if i % 2 == 0 else 'S2'}{i}", "", x, "US", "", "", 0) for i, x in enumerate(xs)], DDL)

    def found(*xs):
        df = at(*xs)
        return pairs(same_premises(df.filter("entity_id like 'S1%'"), df.filter("entity_id like 'S2%'")))

    same = ("12 Wirhubow St, Alphatown, TX 75999", "12 Xyrhubow St, Alphatown, TX 75999", "40 Green Valley Rd, Alphatown, TX 75999", "40 Valley Green Rd, Alphatown, TX 75999", "77 Marlbrook Ave, TX 75999", "77 Marlbrook Ave, Betatown, TX", "5 Elmwood Ct, Betatown, TX 75999", "5 Elmwod Ct, Betatwon")
    assert found(*same) == [("S10", "S21"), ("S12", "S23"), ("S14", "S25"), ("S16", "S27")]
    other = ("12 Wirhubow St, Alphatown, TX 75999", "12 Wirhubow Ave, Alphatown, TX 75999", "40 Green Valley Rd, Alphatown, TX 75999", "40 Green Hill Rd, Alphatown, TX 75999", "7 Elmwood Ct, Alphatown, TX 75999", "7 Elmwood Ct, Gammaville, TX", "9 N Oak St, Alphatown", "9 S Oak St, Alphatown", "8 Oak St, Alphatown", "8 Ash St, Alphatown")
    assert found(*other) == []
    # no locality at all on one side
    assert found("31 Marlbrook Ave, Alphatown, TX 75999", "31 Marlbrok Ave", "32 Marlbrook Ave", "33 Marlbrook Ave, Betatown") == [("S10", "S21")]


def test_recall_of_premises_written_differently(rows):
    """Planted variants: other order, short forms, units, one typing error in street or town, parts left out."""
    rnd = random.Random(5)
    kinds = [("Street", "St"), ("Avenue", "Ave."), ("Boulevard", "Blvd"), ("Court", "Ct")]
    towns = [w.title() for w in words(rnd, 12, 7, 10)]

    def typo(w):
        i = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[:i] + w[i] + w[i:]])

    left, right, want = [], [], set()
    for i in range(300):
        n, street, town = rnd.randint(1, 9999), words(rnd, 1, 8, 11)[0].title(), rnd.choice(towns)
        kind, short = rnd.choice(kinds)
        post = 10000 + towns.index(town)
        left.append((f"S1{i:04}", "", f"{n} {street} {kind}, {town}, TX {post}", "US", "", "", 0))
        s, t = (typo(street), town) if rnd.random() < 0.5 else (street, typo(town))
        right.append((f"S2{i:04}", "", rnd.choice([f"# {n} {s} {short}, Unit {i % 9}, {t}", f"{t}, TX {post}, No. {n} {s} {kind}", f"{n} {s}, {t}, Texas"]), "US", "", "", 0))
        want.add((f"S1{i:04}", f"S2{i:04}"))
    got = set(pairs(same_premises(rows(left, DDL), rows(right, DDL))))
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


DDL = "entity_id string, business_name string, business_address string, country string, n_core string, core string, cls int"


def s1(rows):
    return rows(
        [
            ("S1a", "Blue River Bakery LLC", "12 N Elmwood St, Dallas, TX 75001", "US", "blue river bakery", "?", 1),
            ("S1b", "Red Stone Foods Inc", "99 Oakridge Ave, Tulsa, OK 74101", "US", "red stone foods", "?", 1),
            ("S1c", "The Company", "7 Pinehurst Rd, Dallas, TX 75001", "US", "", "?", 1),
            ("S1d", None, None, "US", None, None, None),
            ("S1e", "Green Valley Motors", "", "US", "green valley motors", "?", 1),
        ],
        DDL,
    )


def others(rows):
    data = [
        ("S2a", "blue rivr bkry", "# 12 Elmwod Street, Unit 5, Dallas", "US"),
        ("S2a", "blue rivr bkry", "# 12 Elmwod Street, Unit 5, Dallas", "US"),
        ("S2b", "Blue River Foods", "12-16 Elmwood St, TX 75001", "US"),
        ("S2c", "Red Stone Foods Trust", "99 Oakridge Ave, Tulsa", "US"),
        ("S2d", "Red Stone Foods", None, "US"),
        ("S3a", "Red Stone Foods", "99 Oakridge Blvd, Tulsa", "US"),
        ("S3b", "Green Valley Motors", "4 Sycamore Ln, Tulsa", "US"),
        ("S3c", None, "12 S Elmwood St, Dallas", "US"),
        ("S3d", "Blue River Bakery", "12 Elmwood St, Dallas", "India"),
        ("S3e", "", "", "US"),
    ]
    return rows([(*x, "clash", "clash", 0) for x in data], DDL)


def pairs(df):
    return sorted((r["s1"], r["o"]) for r in df.collect())


def test_same_premises(rows):
    assert pairs(same_premises(s1(rows), others(rows))) == [("S1a", "S2a"), ("S1a", "S2b"), ("S1b", "S2c")]


def test_same_organisation(rows):
    assert pairs(same_organisation(s1(rows), others(rows), None)) == [("S1a", "S2a"), ("S1b", "S2d"), ("S1b", "S3a"), ("S1e", "S3b")]
    # every name is heavy in so small a table
    assert pairs(same_organisation(s1(rows), others(rows), 0.02)) == []


def test_link_entities(rows):
    got = link_entities(s1(rows), others(rows)).collect()
    assert sorted((r["s1"], r["o"]) for r in got) == [("S1a", "S2a"), ("S1b", "S2d"), ("S1e", "S3b")]
    assert all(0.5 <= r["confidence"] <= 1 for r in got)


def test_words_that_no_list_has_are_learned(rows):
    rnd = random.Random(11)
    own = [w.title() for w in words(rnd, 60, 7, 9)]
    kinds = ["Brewery", "Bicycles", "Aviaries"]
    left = [(f"S1{i:03}", f"{own[i]} {own[i + 30]} {kinds[i % 3]} LLC", "", "US", "x", "", 0) for i in range(30)]
    right = [(f"S2{i:03}", f"{own[i]} {own[i + 30]} {kinds[i % 3]} {'Zorbo' if i % 2 else ''}", "", "US", "", "", 0) for i in range(30)]
    right += [(f"S3{i:03}", f"{own[i]} {own[i + 30]} {kinds[(i + 1) % 3]}", "", "US", "", "", 0) for i in range(30)]
    right += [("S3900", f"{own[0]} {own[30]} Brewerry", "", "US", "", "", 0)]
    taught = learn_words(read_records(rows(left, DDL), True, False), read_records(rows(right, DDL), True, False))
    assert taught.trades == ("aviaries", "bicycles", "brewery") and taught.fillers == ("zorbo",)
    got = pairs(same_organisation(rows(left, DDL), rows(right, DDL), None))
    assert got == sorted([(f"S1{i:03}", f"S2{i:03}") for i in range(30)] + [("S1000", "S3900")])


def planted(rnd, n):
    """S1 rows, records, and the true pairs: copies with typed names, and other businesses at the places of some."""
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "an", "or", "il")]
    word = lambda k: "".join(rnd.choice(syllables) for _ in range(k)).title()
    typo = lambda w: (lambda i: rnd.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i:]]))(rnd.randrange(1, len(w) - 2))
    left, right, want = [], [], set()
    for i in range(n):
        a, b, trade = word(3), word(3), rnd.choice(["Bakery", "Motors", "Foods"])
        place = f"{rnd.randint(1, 9999)} {word(4)} St, Dallas, TX 75001"
        left.append((f"S1{i:04}", f"{a} {b} {trade} LLC", place, "US", "", "", 0))
        for k in range(2):
            name = rnd.choice([f"{typo(a)} {b} {trade}", f"{a} {typo(b)} {trade} Inc", f"{b} {a} {trade}", f"{a}{typo(b)} {trade}", f"{typo(a)} {typo(b)}"])
            right.append((f"S2{i:04}{k}", name, place, "US", "", "", 0))
            want.add((f"S1{i:04}", f"S2{i:04}{k}"))
        if i % 3 == 0:
            right.append((f"S3{i:04}", f"{word(3)} {word(3)} {trade}", place, "US", "", "", 0))
        elif i % 10 == 1:  # hard to tell: a part of the name, or half of another
            right.append((f"S3{i:04}", rnd.choice([f"{typo(a)} {trade}", f"{typo(a)} {word(3)} {trade}", f"{typo(typo(typo(a)))} {typo(typo(b))}"]), place, "US", "", "", 0))
    return left, right, want


def test_the_model_decides_between_businesses_at_one_place(rows):
    left, right, want = planted(random.Random(7), 150)
    got = link_entities(rows(left, DDL), rows(right, DDL), least=0.0).collect()
    told = {(r["s1"], r["o"]): r["confidence"] for r in got}
    sure = {p for p, c in told.items() if c >= 0.5}
    score = lambda found: (len(found & want) / len(want), len(found & want) / len(found))
    assert min(score(sure)) >= 0.9
    # without the model every record at a place would be a match
    assert len(told) > len(sure) and score(set(told))[1] < 0.9
    assert sure == set(pairs(link_entities(rows(left, DDL), rows(right, DDL))))
    # confidences are of use: they are not all alike, and their mean is near the share of true pairs
    assert len({round(c, 3) for c in told.values()}) > 3 and abs(sum(told.values()) / len(told) - score(set(told))[1]) < 0.05


def test_spellings_of_one_organisation_compete_together(rows):
    names = ["Venforro Menlimi Realty", "Venfrro Menlimi Realty", "Venfrro Mnlimi Realty", "Venforro Menlimi Bakery", "Vonforru Menlimu Realty"]
    left = rows([(f"S1{i}", x, f"{i + 10} Elm St, Dallas, TX 75001", "US", x, "", 0) for i, x in enumerate(names)], DDL)
    right = rows([("S2a", "Venforro Menlimi Realty", "", "US", "", "", 0), ("S2b", "Venfrro Menlimi Realty Inc", "", "US", "", "", 0)], DDL)
    assert pairs(same_organisation(left, right, None)) == [(s, o) for s in ("S10", "S11", "S12") for o in ("S2a", "S2b")]


def test_repeated_deliveries_count_once(rows):
    again = others(rows).filter("entity_id in ('S2d', 'S3b')")
    # S2d has no address, S1e (the row of S3b) has none either
    assert [("S1b", "S2d"), ("S1e", "S3b")] == pairs(link_entities(s1(rows), again.unionByName(again)))
    assert [("S1b", "S2d"), ("S1e", "S3b")] == pairs(link_entities(s1(rows).unionByName(s1(rows)), again))


def test_large_name_classes_are_linked_through_representatives(rows):
    left = rows([(1, f"a{i}") for i in range(6)] + [(2, "b0")], "cls int, left_id string")
    right = rows([(1, f"x{i}") for i in range(5)] + [(2, "y0"), (2, "y1"), (3, "z")], "cls int, right_id string")
    assert len(pairs(record_pairs(left, right, 30))) == 32
    got = pairs(record_pairs(left, right, 29))
    assert got == sorted([(f"a{i}", "x0") for i in range(6)] + [("a0", f"x{i}") for i in range(1, 5)] + [("b0", "y0"), ("b0", "y1")])


def test_large_organisations_have_all_their_pairs(rows):
    left = rows([(f"S1{i:03}", "Venforro Menlimi Realty", "", "US", "x", "", 0) for i in range(102)], DDL)
    right = rows([(f"S2{i:03}", "Venforro Menlimi Realty Inc", "", "US", "", "", 0) for i in range(100)], DDL)
    assert pairs(same_organisation(left, right, None)) == [(f"S1{i:03}", f"S2{k:03}") for i in range(102) for k in range(100)]


def test_empty_sides(rows):
    some, none = others(rows), rows([], DDL)
    for f in (same_premises, lambda a, b: same_organisation(a, b, None), link_entities):
        assert f(s1(rows), none).collect() == [] and f(none, some).collect() == [] and f(none, none).collect() == []


def test_expand_pairs_in_cells(rows):
    left = [(1, f"a{i}") for i in range(50)] + [(2, "b0")]
    right = [(1, f"x{i}") for i in range(60)] + [(2, "y0"), (3, "z")]
    got = expand_pairs(rows(left, "cls int, left_id string"), rows(right, "cls int, right_id string"), cell=100).collect()
    assert len(got) == 3001 and {tuple(r) for r in got} == {(a, x) for c, a in left for k, x in right if c == k}


def test_label_model_learns_accuracies_and_correlations():
    rnd = np.random.default_rng(1)
    n, right = 8000, (0.92, 0.88, 0.84, 0.8, 0.75)
    truth = rnd.random(n) < 0.4
    votes = np.full((n, 6), 2)
    for f, r in enumerate(right):
        votes[:, f] = np.where((rnd.random(n) < r) == truth, 0, 3)
    votes[:, 5] = votes[:, 4]  # the least accurate function, said twice
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = fit_label_model(patterns, count.astype(float))
    said = model.posterior(votes) >= 0.5
    assert (said == truth).mean() > 0.93
    assert model.parent[5] == 4 or model.parent[4] == 5
