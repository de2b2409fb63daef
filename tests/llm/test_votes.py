import random

from kinloom.llm.labelmodel import FUNCTIONS, name_votes
from tests.llm.test_linkage import lev


def test_votes_on_names_are_those_of_whole_comparisons(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        first, second = ("".join(rnd.choice("abc") for _ in range(rnd.randint(3, 8))) for _ in "xy")
        other = [first, second] if rnd.random() < 0.5 else [second, first]
        k = rnd.randint(0, 3)
        other = [w[:k] + rnd.choice(["", "x", w[k : k + 1]]) + w[k + 1 :] for w in other] if rnd.random() < 0.8 else ["q" * 9]
        rows.append((f"{first} {second}", " ".join(other), "", "", "", ""))
    voted = name_votes(spark.createDataFrame(rows, "l_words string, r_words string, l_given string, r_given string, l_trade string, r_trade string"))
    # letters are sorted by compiled code
    assert "array_sort" not in voted._jdf.queryExecution().toString()
    for x in voted.collect():
        a, b = x["l_words"].replace(" ", ""), x["r_words"].replace(" ", "")
        head, _, tail = x["r_words"].partition(" ")
        turned = lev(a, tail + head) if tail else 10_000
        assert x["edits"] == min(lev(a, b), turned)
        jumbled = lev("".join(sorted(a)), "".join(sorted(b))) if x["edits"] else 0
        want = 0 if jumbled <= 1 else 1 if jumbled <= 0.3 * max(len(a), len(b)) else 3
        assert x["v_name"] >> 2 * FUNCTIONS.index("letters") & 3 == want
