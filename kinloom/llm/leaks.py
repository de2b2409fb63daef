"""Problem 8: passages of evaluation items inside the documents of a training corpus.

Winnowing. Words are numbered by the vocabulary of the items; of every window of ``window`` neighbouring word k-grams
the one with the least hash is kept, on both sides, so any span of ``k + window - 1`` shared words leaves a shared
fingerprint. The items' fingerprints are joined with those of the documents as the documents stream by, without a
shuffle: the items are the stated query set, broadcast in blocks of a bounded number of words, one pass of the corpus
for each block. A hit is extended in three steps, each exact and cheaper than the next: words matched on
neighbouring diagonals around it, an alignment of the item with that part of the document, and the rule itself: at
least ``exact_words`` running words unchanged, or at least ``loose_words`` with at most one word in ``loose_rate``
changed or missing (a word put in counts as changed).

What does not count as a change: case, accents and other marks, character forms (see ``forms``), spacing, punctuation,
and breaks inside words at line ends.

Guarantee: an unchanged span of ``exact_words`` is always found. A changed span of 24 words with four errors keeps 20
words in five runs, one of which has at least k + window - 1 = 4 words, so it leaves a fingerprint too.

Defined results: NULL and blank texts hold nothing; items below ``exact_words`` words are never found; repeated
documents are reported each by its id; several hits of one item in a document give one row; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.forms import ordinary
from kinloom.session import materialize

_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*[\r\n]\s*(?=\w)")
_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakParams:
    k: int = 3
    window: int = 2
    exact_words: int = 14
    loose_words: int = 24
    loose_rate: int = 6
    drift: int = 4
    block_words: int = 2_000_000


def plain_words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    text = _BREAK.sub("", ordinary(text)).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(ids: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-gram that starts at each place, as one number; -1 where a word is not in the vocabulary or the text ends."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    bad = np.zeros(n, dtype=bool)
    for j in range(k):
        part = ids[j : j + n]
        out = out * size + np.maximum(part, 0)
        bad |= part < 0
    out[bad] = -1
    return out


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the k-grams kept: the least hash of every window of neighbouring ones. Grams of -1 are never kept."""
    if not len(g):
        return np.zeros(0, dtype=np.int64)
    h = _mix(g)
    h[g < 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(g) < window:
        keep = np.zeros(len(g), dtype=bool)
        keep[int(h.argmin())] = True
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        at = views.argmin(axis=1) + np.arange(len(views))
        keep = np.zeros(len(g), dtype=bool)
        keep[at] = True
    return np.nonzero(keep & (g >= 0))[0]


class ItemIndex:
    """Fingerprints of one block of items. Texts lie in one array of word numbers, with gaps between them."""

    def __init__(self, items: list[tuple[int, list[str]]], p: LeakParams) -> None:
        self.p = p
        self.names = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: i for i, w in enumerate(self.names)}
        self.size = max(2, len(self.names))
        if self.size**p.k >= 2**62:
            raise ValueError("block_words is too large for k")
        self.item_ids = np.array([i for i, _ in items], dtype=np.int64)
        self.pad = 3 * p.loose_words
        parts, starts, at = [np.full(self.pad, -2, dtype=np.int32)], [], self.pad
        places, found = [], []
        for _, ws in items:
            ids = np.array([self.vocabulary[w] for w in ws], dtype=np.int32)
            starts.append(at)
            g = grams(ids.astype(np.int64), p.k, self.size)
            keep = winnow(g, p.window)
            found.append(g[keep])
            places.append(keep + at)
            parts += [ids, np.full(self.pad, -2, dtype=np.int32)]
            at += len(ids) + self.pad
        self.words = np.concatenate(parts)
        self.starts = np.array(starts, dtype=np.int64)
        self.lengths = np.array([len(ws) for _, ws in items], dtype=np.int64)
        g = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(g, kind="stable")
        self.sorted_grams = g[order]
        self.places = (np.concatenate(places) if places else np.zeros(0, dtype=np.int64))[order]

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into g, item place) of all shared fingerprints."""
        lo = np.searchsorted(self.sorted_grams, g, side="left")
        n = np.searchsorted(self.sorted_grams, g, side="right") - lo
        which = np.repeat(np.arange(len(g)), n)
        if not len(which):
            return which, which
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.places[np.repeat(lo, n) + within]


def errors_of(p: LeakParams) -> int:
    """The most errors in a stretch that fulfils the loose rule and is too short to be halved."""
    return (2 * p.loose_words - 1) // p.loose_rate


#: Diagonals in a strip, at least: more than the errors of a passage (``errors_of``) can spread its hits over.
STRIP = 16


def least_hits(p: LeakParams) -> int:
    """How many shared fingerprints any passage that fulfils a rule leaves at least.

    A run of L unchanged words has L - k + 1 grams, of which at least every ``window``-th is kept; e errors make e + 1 runs.
    """
    exact = (p.exact_words - p.k + 1) // p.window
    loose = min(-(-(n - n // p.loose_rate - (n // p.loose_rate + 1) * (p.k + p.window - 2)) // p.window) for n in range(p.loose_words, 2 * p.loose_words))
    return max(1, min(exact, loose))


def _promising(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, p: LeakParams, step: int = 20_000) -> np.ndarray:
    """Hits around which enough words agree, on the hit's own diagonal or one near by, to fulfil a rule.

    A stretch of ``2 * loose_words`` or more that fulfils the loose rule has a half that does, so shorter ones are all that
    need be looked for. They hold at most ``errors_of(p)`` errors, which bounds how far words leave the hit's diagonal.
    """
    reach = 2 * p.loose_words - 2
    span = np.arange(-reach, reach + p.k + 1)
    most = errors_of(p)
    ok = np.zeros(len(d), dtype=bool)
    for s in range(0, len(d), step):
        dd, ii = d[s : s + step], i[s : s + step]
        left = item[ii[:, None] + span]
        hit = doc[dd[:, None] + span] == left
        run = np.concatenate([np.zeros((len(dd), 1), np.int16), np.cumsum(hit, axis=1, dtype=np.int16)], axis=1)
        good = (run[:, p.exact_words :] - run[:, : -p.exact_words] == p.exact_words).any(axis=1)
        # the neighbours only for hits that could still make it: enough words of the item occur near by at all
        rest = np.nonzero(~good)[0]
        if len(rest):
            any_ = hit[rest]
            for shift in range(1, max(p.drift, most) + 1):
                for sign in (-shift, shift):
                    any_ = any_ | (doc[dd[rest, None] + span + sign] == left[rest])
            run = np.concatenate([np.zeros((len(rest), 1), np.int16), np.cumsum(any_, axis=1, dtype=np.int16)], axis=1)
            # any window of the least length inside such a stretch has at most its errors; the lengths themselves for what is left
            left_over = np.nonzero((run[:, p.loose_words :] - run[:, : -p.loose_words] >= p.loose_words - most).any(axis=1))[0]
            run = run[left_over]
            enough = np.zeros(len(left_over), dtype=bool)
            for n in range(p.loose_words, 2 * p.loose_words):
                enough |= (run[:, n:] - run[:, :-n] >= n - n // p.loose_rate).any(axis=1)
            good[rest[left_over]] = enough
        ok[s : s + step] = good
    return ok


def aligned(item: np.ndarray, doc: np.ndarray, offset: int, band: int) -> np.ndarray:
    """What becomes of each item word in the best alignment near a diagonal: 1 unchanged, 0 changed or missing, and
    -1 added for every word put in before it. ``doc[j]`` stands at ``item[i]`` for j = i + offset."""
    n = len(item)
    width = 2 * band + 1
    low = -(10**6)
    score = np.full((n + 1, width), low, dtype=np.int32)
    score[0, :] = 0
    move = np.zeros((n + 1, width), dtype=np.int8)
    a, b, m = item.tolist(), doc.tolist(), len(doc)
    rows = score.tolist()
    moves = move.tolist()
    for i in range(1, n + 1):
        last, row, mv = rows[i - 1], rows[i], moves[i]
        for c in range(width):
            j = i - 1 + offset + c - band
            best, how = low, 0
            if 0 <= j < m:
                same = a[i - 1] == b[j]
                best, how = last[c] + (2 if same else -1), 1
            if c + 1 < width and last[c + 1] - 1 > best:
                best, how = last[c + 1] - 1, 2
            if c > 0 and row[c - 1] - 1 > best:
                best, how = row[c - 1] - 1, 3
            row[c], mv[c] = best, how
    c = max(range(width), key=lambda x: rows[n][x])
    i = n
    state = [0] * n
    while i > 0:
        how = moves[i][c]
        if how == 1:
            j = i - 1 + offset + c - band
            if a[i - 1] == b[j]:
                state[i - 1] += 1
            i -= 1
        elif how == 2:
            i -= 1
            c += 1
        elif how == 3:
            state[i - 1] -= 1
            c -= 1
        else:
            break
    return np.array(state, dtype=np.int32)


def fulfils(state: np.ndarray, p: LeakParams) -> bool:
    """Whether some stretch of item words fulfils a rule, for a state as ``aligned`` gives it."""
    good = state >= 1
    run = np.concatenate([[0], np.cumsum(state == 1)])
    n = len(state)
    if n >= p.exact_words and (run[p.exact_words :] - run[: -p.exact_words] == p.exact_words).any():
        return True
    errors = np.where(good, 0, 1) + np.where(state < 0, -state, 0)
    total = np.concatenate([[0], np.cumsum(errors)])
    for length in range(p.loose_words, n + 1):
        if ((total[length:] - total[:-length]) * p.loose_rate <= length).any():
            return True
    return False


def find_in(texts: list[str | None], index: ItemIndex, p: LeakParams) -> list[tuple[int, int]]:
    """(position of the text, item id) of all leaks in a batch of texts."""
    pad = index.pad
    parts, starts, at = [np.full(pad, -1, dtype=np.int32)], [], pad
    get = index.vocabulary.get
    for t in texts:
        ids = np.array([get(w, -1) for w in plain_words(t)], dtype=np.int32) if t else np.zeros(0, dtype=np.int32)
        starts.append(at)
        parts += [ids, np.full(pad, -1, dtype=np.int32)]
        at += len(ids) + pad
    doc = np.concatenate(parts)
    g = grams(doc.astype(np.int64), p.k, index.size)
    # windows across the gap between texts hold only grams of -1 beside those of one text
    keep = winnow(g, p.window)
    which, place = index.lookup(g[keep])
    if not len(which):
        return []
    d, i = keep[which], place
    # the hits of a passage lie on diagonals no further apart than its errors, so in two neighbouring strips of diagonals;
    # where two strips of a text and an item have too few of them there is no passage
    strip = (d - i) // max(STRIP, errors_of(p) + 1)
    strip -= strip.min()
    pair = (np.searchsorted(np.array(starts), d, side="right") - 1) * np.int64(len(index.item_ids)) + np.searchsorted(index.starts, i, side="right") - 1
    strips, at, count = np.unique(pair * (int(strip.max()) + 2) + strip, return_inverse=True, return_counts=True)
    together = np.concatenate([[0], np.where(np.diff(strips) == 1, count[1:] + count[:-1], 0), [0]])
    some = np.maximum(count, np.maximum(together[1:], together[:-1]))[at] >= least_hits(p)
    d, i = d[some], i[some]
    if not len(d):
        return []
    # one hit for each diagonal and stretch of a few words is enough: the neighbourhood looked at covers the rest
    key = (d - i) * np.int64(1 << 32) + i // p.k
    _, first = np.unique(key, return_index=True)
    d, i = d[first], i[first]
    ok = _promising(doc, index.words, d, i, p)
    d, i = d[ok], i[ok]
    where = np.searchsorted(np.array(starts), d, side="right") - 1
    item = np.searchsorted(index.starts, i, side="right") - 1
    done: set[tuple[int, int]] = set()
    tried: set[tuple[int, int, int]] = set()
    band = max(p.drift, errors_of(p)) + 2
    for w, it, x, y in zip(where.tolist(), item.tolist(), d.tolist(), i.tolist(), strict=True):
        if (w, it) in done:
            continue
        n, s = int(index.lengths[it]), int(index.starts[it])
        begin = x - (y - s) - 2 * band
        near = (w, it, (x - y) // 2)
        if near in tried:
            continue
        tried.add(near)
        part = doc[max(0, begin) : begin + n + 4 * band]
        state = aligned(index.words[s : s + n], part, 2 * band + min(0, begin), band)
        if fulfils(state, p):
            done.add((w, it))
    return [(w, int(index.item_ids[it])) for w, it in done]


def item_blocks(items: DataFrame, p: LeakParams) -> Iterator[ItemIndex]:
    """The query set, read row by row to the driver, in blocks of at most ``block_words`` words."""
    block: list[tuple[int, list[str]]] = []
    words = 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        ws = plain_words(row["text"])
        if len(ws) < p.exact_words:
            continue
        if block and words + len(ws) > p.block_words:
            yield ItemIndex(block, p)
            block, words = [], 0
        block.append((int(row["item_id"]), ws))
        words += len(ws)
    if block:
        yield ItemIndex(block, p)


def find_leaks(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id): documents whose text carries a passage of an item."""
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    out, alone = spark.createDataFrame([], schema), True
    blocks = item_blocks(items, params)
    index = next(blocks, None)
    while index is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 500):
                    part = pdf.iloc[at : at + 500]
                    ids = part["doc_id"].to_numpy()
                    hits = find_in(part["text"].tolist(), shared.value, params)
                    if hits:
                        yield pd.DataFrame({"doc_id": [ids[w] for w, _ in hits], "item_id": [i for _, i in hits]})

        found = texts.mapInPandas(search, schema)
        alone = alone and after is None
        if not alone:  # one block's fingerprints are held at a time: its result is written before the next is made
            found = materialize(found, "leaks", keep=True)
            shared.destroy()
        out = out.unionByName(found)
        index = after
    return out.distinct()
