import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinloom.functions import kernels as k

words = st.text(alphabet="abcd ", max_size=12)


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


@given(words, words)
def test_lcs(a, b):
    assert k.lcs(a, b) == slow_lcs(a, b)


@given(words, words)
def test_bounds_and_symmetry(a, b):
    for f in (k.ratio, k.token_sort_ratio, k.token_set_ratio, k.partial_ratio):
        assert 0 <= f(a, b) <= 100
        assert f(a, b) == pytest.approx(f(b, a))
    assert 0 <= k.jaro_winkler(a, b) <= 1


@given(st.text(alphabet="abc", min_size=1, max_size=6), st.text(alphabet="abc", min_size=1, max_size=9))
def test_partial_ratio_is_the_best_window(a, b):
    if len(a) > len(b):
        a, b = b, a
    both = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    best = max(k.ratio(x, y[max(0, s) : min(len(y), s + len(x))]) for x, y in both for s in range(-len(x) + 1, len(y)))
    assert k.partial_ratio(a, b) == pytest.approx(best)


def test_worked_examples():
    assert k.ratio("", "") == 100 and k.ratio("a", "") == 0
    assert round(k.ratio("kitten", "sitting"), 6) == round(200 * 4 / 13, 6)
    assert k.token_sort_ratio("fuzzy wuzzy was", "was wuzzy fuzzy") == 100
    assert k.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert k.token_set_ratio("", "a") == 0
    assert k.partial_ratio("yankees", "new york yankees") == 100
    assert round(k.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert k.weighted_ratio("", "x") == 0


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_edit_operations_are_a_least_script(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != y)))
        d = row
    assert len(k.edit_operations(a, b)) == d[-1]


def test_edit_codes():
    assert k.edit_code("abc", "abc") == 0
    assert k.edit_code("abc", "xbc") == 10
    assert k.edit_code("abcd", "axcd") == 11
    assert k.edit_code("abc", "abx") == 12
    assert k.edit_code("abc", "ab") == 22
    assert k.edit_code("abcd", "wxyz") == 0


def test_near_flags(rows):
    df = rows([(["bakery", "inc"], ["bakry", "inc"]), (None, ["x"]), ([], [])], "a array<string>, b array<string>")
    got = [list(r[0]) for r in df.select(k.near_flags()("a", "b")).collect()]
    assert got == [[True, False], [], []]


def test_kernels_of_many_pairs_agree_with_those_of_one():
    rnd = random.Random(12)
    text = lambda: "".join(rnd.choice("abcdé  f") for _ in range(rnd.choice([0, 1, 3, 9, 14, 25, 62, 63, 64, 80])))
    a, b = [text() for _ in range(600)], [text() for _ in range(600)]
    b[:100] = [x[3:] + "q" for x in a[:100]]
    for one, many in k.MANY.items():
        assert np.allclose(many(a, b), [one(x, y) for x, y in zip(a, b)]), one.__name__
        assert len(many([], [])) == 0
    assert k.partial_many(["x" * 30], ["y" * 3000 + "x" * 30]).tolist() == [100.0]
