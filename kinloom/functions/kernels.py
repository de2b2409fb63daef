"""String similarity kernels on pairs of columns.

The indel ratio needs the longest common subsequence, which is computed bit-parallel: a Python integer holds a whole
row of the table, so a character of the right string costs a handful of operations whatever the left one's length. The
kernels run as Arrow UDFs, with equal pairs of a batch computed once, and most of them for all pairs of a batch at a time, a pair (or
a window of one) in each lane of an array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (Hyyro's bit-vector form)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """K1: 100 * 2 * lcs / (len a + len b); 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    """K2."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """K3: of the common tokens, and these with either rest, the best ratio; 0 if a side has no token."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    common = sorted(left & right)
    rest_a, rest_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and (not rest_a or not rest_b):
        return 100.0
    head = " ".join(common)
    with_a, with_b = (f"{head} {x}" if head else x for x in (rest_a, rest_b))
    best = 200.0 * (len(head) + (1 if head else 0) + lcs(rest_a, rest_b)) / (len(with_a) + len(with_b))
    if head:
        best = max(best, *(200.0 * len(head) / (len(head) + len(x)) for x in (with_a, with_b)))
    return best


def _best_window(a: str, b: str) -> float:
    """The best ratio of ``a`` with the windows of its length in ``b``, cut short at the edges.

    The letters that a window shares with ``a``, counted as it slides, bound its ratio; windows are tried from the
    greatest bound on, until none can beat what was found. A window that neither begins nor ends with a letter of ``a`` gains
    nothing on a neighbour.
    """
    n, m = len(a), len(b)
    spare: dict[str, int] = {}
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        spare[c] = spare.get(c, 0) + 1
        where[c] = where.get(c, 0) | 1 << i
    windows: list[tuple[float, int, int]] = []
    common = lo = hi = 0
    for start in range(-n + 1, m):
        if start + n <= m:
            c = b[hi]
            hi += 1
            left = spare.get(c)
            if left is not None:
                spare[c] = left - 1
                common += left > 0
        if start > 0:
            c = b[lo]
            lo += 1
            left = spare.get(c)
            if left is not None:
                spare[c] = left + 1
                common -= left >= 0
        if common and (b[hi - 1] in where or b[lo] in where):
            windows.append((200.0 * common / (n + hi - lo), lo, hi))
    windows.sort(reverse=True)
    best, full = 0.0, (1 << n) - 1
    for bound, lo, hi in windows:
        if bound <= best:
            break
        row = full
        for c in b[lo:hi]:
            hit = row & where.get(c, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        best = max(best, 200.0 * (n - row.bit_count()) / (n + hi - lo))
    return best


def partial_ratio(a: str, b: str) -> float:
    """K4: the best ratio of the shorter string with a window of the longer, windows at the edges cut short; of equally
    long strings either may be the one with windows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(_best_window(a, b), _best_window(b, a)) if len(a) == len(b) else _best_window(a, b)


def weighted_ratio(a: str, b: str) -> float:
    """K5: the plain ratio or scaled token ratios; partial ones if the lengths differ much."""
    if not a or not b:
        return 0.0
    tokens = lambda x, y: max(token_sort_ratio(x, y), token_set_ratio(x, y))
    plain = ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(plain, 0.95 * tokens(a, b))
    scale = 0.9 if spread <= 8 else 0.6
    sort_a, sort_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    left, right = set(a.split()), set(b.split())
    if left & right:
        partial_tokens = 100.0
    else:
        partial_tokens = max(partial_ratio(sort_a, sort_b), partial_ratio(" ".join(sorted(left - right)), " ".join(sorted(right - left))))
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_tokens)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """K6: with prefix weight 0.1 on up to four characters, where Jaro exceeds 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def edit_operations(a: str, b: str) -> list[tuple[str, int]]:
    """K8: replace, delete and insert steps of a least edit script, with the place in ``a``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    table = [list(range(len(y) + 1))]
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (c != d)))
        table.append(row)
    steps: list[tuple[str, int]] = []
    i, j = len(x), len(y)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            if x[i - 1] != y[j - 1]:
                steps.append(("replace", head + i - 1))
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] + 1:
            steps.append(("delete", head + i - 1))
            i -= 1
        else:
            steps.append(("insert", head + i))
            j -= 1
    return steps[::-1]


def edit_code(u: str, v: str) -> int:
    """V3: 0 for none or more than two steps, else kind * 10 + place (0 first, 1 middle, 2 last) of the first, 100 more for two."""
    steps = edit_operations(u, v)
    if not steps or len(steps) > 2:
        return 0
    kind, at = steps[0]
    place = 0 if at == 0 else 2 if at >= len(u) - 1 else 1
    return {"replace": 1, "delete": 2, "insert": 3}[kind] * 10 + place + (100 if len(steps) == 2 else 0)


#: Strings of more letters than a word has bits go one by one.
LANE_BITS = 63


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points (texts, longest), 0 beyond their ends; lengths)"""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(1, int(length.max(initial=0)))
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width), length


def _lanes(a: list[str], b: list[str], pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Common subsequence lengths of ``a[pair]`` (at most ``LANE_BITS`` letters) and the windows ``b[pair][lo:hi]``, a lane each."""
    ca, la = _coded(a)
    cb, _ = _coded(b)
    letters, codes = np.unique(ca, return_inverse=True)
    codes = codes.reshape(ca.shape)
    masks = np.zeros((len(a), len(letters) + 1), dtype=np.uint64)
    for k in range(ca.shape[1]):
        some = np.nonzero(la > k)[0]
        masks[some, codes[some, k]] |= np.uint64(1 << k)
    at = np.minimum(np.searchsorted(letters, cb), len(letters) - 1)
    at = np.where(letters[at] == cb, at, len(letters))
    order = np.argsort(lo - hi, kind="stable")
    pair, lo, size = pair[order], lo[order], (hi - lo)[order]
    row = np.full(len(pair), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # the longest come first; those that ended keep their row
        v = row[:n]
        hit = v & masks[pair[:n], at[pair[:n], lo[:n] + t]]
        row[:n] = (v + hit) | (v - hit)
    low = np.left_shift(np.uint64(1), la[pair].astype(np.uint64)) - np.uint64(1)
    out = np.empty(len(pair), dtype=np.int64)
    out[order] = np.bitwise_count(~row & low)
    return out


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`lcs` of many pairs at once."""
    out = np.zeros(len(a), dtype=np.int64)
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short = [i for i, (x, y) in enumerate(swap) if 0 < len(x) <= LANE_BITS and len(y) <= 1000]
    for k in range(0, len(short), 4096):
        part = short[k : k + 4096]
        x, y = [swap[i][0] for i in part], [swap[i][1] for i in part]
        out[part] = _lanes(x, y, np.arange(len(part)), np.zeros(len(part), dtype=np.int64), np.array([len(t) for t in y], dtype=np.int64))
    done = set(short)
    for i, (x, y) in enumerate(swap):
        if x and i not in done:
            out[i] = lcs(x, y)
    return out


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(total == 0, 100.0, 200.0 * lcs_many(a, b) / np.maximum(total, 1))


def _sorted_tokens(a: list[str]) -> list[str]:
    return [" ".join(sorted(x.split())) for x in a]


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_many(_sorted_tokens(a), _sorted_tokens(b))


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    sets = [(set(x.split()), set(y.split())) for x, y in zip(a, b, strict=True)]
    heads = [" ".join(sorted(x & y)) for x, y in sets]
    rests = [" ".join(sorted(x - y)) for x, y in sets], [" ".join(sorted(y - x)) for x, y in sets]
    shared = lcs_many(*rests)
    out = np.zeros(len(a))
    for i, (head, ra, rb) in enumerate(zip(heads, *rests, strict=True)):
        if not sets[i][0] or not sets[i][1]:
            continue
        if head and (not ra or not rb):
            out[i] = 100.0
            continue
        h = len(head)
        wa, wb = (h + 1 + len(x) if h else len(x) for x in (ra, rb))
        best = 200.0 * (h + (1 if h else 0) + int(shared[i])) / (wa + wb)
        out[i] = max(best, 200.0 * h / (h + wa), 200.0 * h / (h + wb)) if h else best
    return out


def partial_many(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`partial_ratio` of many pairs, all windows of a pair at once."""
    out = np.zeros(len(a))
    lanes: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            out[i] = 100.0 if not y else 0.0
        elif len(x) <= LANE_BITS and len(y) <= 1000:
            lanes.append((i, x, y))
            if len(x) == len(y):
                lanes.append((i, y, x))
        else:
            out[i] = partial_ratio(x, y)
    lanes.sort(key=lambda t: len(t[2]))
    start = 0
    while start < len(lanes):
        step = max(1, 60_000 // (2 * len(lanes[min(start + 999, len(lanes) - 1)][2])))
        part = lanes[start : start + step]
        start += step
        n, m = (np.array([len(t[c]) for t in part], dtype=np.int64) for c in (1, 2))
        count = n + m - 1
        pair = np.repeat(np.arange(len(part)), count)
        first = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) - n[pair] + 1
        lo, hi = np.maximum(first, 0), np.minimum(first + n[pair], m[pair])
        got = 200.0 * _lanes([t[1] for t in part], [t[2] for t in part], pair, lo, hi) / (n[pair] + hi - lo)
        best = np.maximum.reduceat(got, np.cumsum(count) - count)
        np.maximum.at(out, [t[0] for t in part], best)
    return out


def weighted_many(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`weighted_ratio` of many pairs."""
    out = np.zeros(len(a))
    some = [i for i in range(len(a)) if a[i] and b[i]]
    x, y = [a[i] for i in some], [b[i] for i in some]
    plain = ratio_many(x, y)
    spread = np.array([max(len(p), len(q)) / min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
    near, far = np.nonzero(spread < 1.5)[0], np.nonzero(spread >= 1.5)[0]
    best = plain.copy()
    of = lambda v, at: [v[i] for i in at]
    if len(near):
        tokens = np.maximum(token_sort_many(of(x, near), of(y, near)), token_set_many(of(x, near), of(y, near)))
        best[near] = np.maximum(plain[near], 0.95 * tokens)
    if len(far):
        fx, fy = of(x, far), of(y, far)
        scale = np.where(spread[far] <= 8, 0.9, 0.6)
        sets = [(set(p.split()), set(q.split())) for p, q in zip(fx, fy, strict=True)]
        common = np.array([bool(p & q) for p, q in sets])
        tokens = np.full(len(far), 100.0)
        apart = np.nonzero(~common)[0]
        if len(apart):
            rests = [" ".join(sorted(sets[i][0] - sets[i][1])) for i in apart], [" ".join(sorted(sets[i][1] - sets[i][0])) for i in apart]
            tokens[apart] = np.maximum(partial_many(_sorted_tokens(of(fx, apart)), _sorted_tokens(of(fy, apart))), partial_many(*rests))
        best[far] = np.maximum(plain[far], np.maximum(scale * partial_many(fx, fy), 0.95 * scale * tokens))
    out[some] = best
    return out


#: Kernels that have a form for many pairs at once.
MANY = {ratio: ratio_many, token_sort_ratio: token_sort_many, token_set_ratio: token_set_many, partial_ratio: partial_many, weighted_ratio: weighted_many}


def pairwise(kernel: Callable[[str, str], float], kind: T.DataType | None = None) -> Callable[[Column, Column], Column]:
    """An Arrow UDF of a kernel; NULL counts as the empty string."""

    @F.pandas_udf(kind or T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [(x or "", y or "") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        place: dict[tuple[str, str], int] = {}
        at = [place.setdefault(p, len(place)) for p in pairs]
        many = MANY.get(kernel)
        got = many([x for x, _ in place], [y for _, y in place]) if many else np.array([kernel(x, y) for x, y in place])
        return pd.Series(got[at] if len(at) else got)

    return lambda a, b: run(a, b)


def _has_near(tokens: list[str], others: list[str], least: int) -> list[bool]:
    """For each token whether some other one of at least four letters is near it, in whole numbers to stay exact."""
    return [len(t) >= 4 and any(200 * lcs(t, u) >= least * (len(t) + len(u)) for u in others) for t in tokens]


def near_flags(least: int = 85) -> Callable[[Column, Column], Column]:
    """For arrays of tokens: array of 'some token of the other side is at least ``least`` alike', for the first array."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = lru_cache(maxsize=200_000)(lambda x, y: 200 * lcs(x, y) >= least * (len(x) + len(y)))
        out = []
        for xs, ys in zip(a.tolist(), b.tolist(), strict=True):
            ys = [] if ys is None else list(ys)
            out.append([len(x) >= 4 and any(known(x, y) for y in ys) for x in ([] if xs is None else xs)])
        return pd.Series(out)

    return lambda a, b: run(a, b)
