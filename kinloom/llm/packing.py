"""Problem 7: filling fixed-capacity containers with items that are never split unless they exceed the capacity.

Harmonic packing. A length s with C / (k + 1) < s <= C / k belongs to class k, and k documents of class k always fit one
container, so a class's containers take a fixed count of documents and need no look at their sizes. Every
worker fills its own containers, window by window of its rows, and nothing is shuffled. Two refinements of
the plain method keep unused space small: gaps of containers of the large classes take small documents (best fit), and
the documents of a window that do not complete a container of their class are packed together, largest first.

A text above the capacity is cut into pieces of exactly the capacity, each in a container of its own, and a last piece
that is packed like any document. Defined results: NULL texts have no container and no row; an empty text has
0 tokens and one row; a table without rows gives none; repeated documents are packed each; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The public tokenizer in a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def size_class(size: int, capacity: int) -> int:
    """The k with capacity / (k + 1) < size <= capacity / k."""
    return capacity // max(size, 1)


def pack(sizes: list[int], capacity: int, small_from: int = 6) -> list[int]:
    """A container number for every size (each at most ``capacity``), filled by class, then gaps, then the rest."""
    where = [-1] * len(sizes)
    n = 0
    classes: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        classes[size_class(s, capacity)].append(i)
    gaps: list[tuple[int, int]] = []  # (unused, container), kept sorted
    rest: list[int] = []
    for k in sorted(c for c in classes if c < small_from):
        members = classes[k]
        whole = len(members) // k * k
        for at in range(0, whole, k):
            group = members[at : at + k]
            for i in group:
                where[i] = n
            gaps.append((capacity - sum(sizes[i] for i in group), n))
            n += 1
        rest += members[whole:]
    gaps.sort()
    left: dict[int, list[int]] = defaultdict(list)
    for k in sorted(c for c in classes if c >= small_from):
        for i in classes[k]:
            at = bisect_left(gaps, (sizes[i], -1))
            if at < len(gaps):
                unused, b = gaps.pop(at)
                where[i] = b
                if unused > sizes[i]:
                    insort(gaps, (unused - sizes[i], b))
            else:
                left[k].append(i)
    for k, members in sorted(left.items()):
        whole = len(members) // k * k
        for at in range(0, whole, k):
            for i in members[at : at + k]:
                where[i] = n
            n += 1
        rest += members[whole:]
    open_: list[tuple[int, int]] = []
    for i in sorted(rest, key=lambda i: (-sizes[i], i)):
        at = bisect_left(open_, (sizes[i], -1))
        if at < len(open_):
            unused, b = open_.pop(at)
        else:
            unused, b = capacity, n
            n += 1
        where[i] = b
        if unused > sizes[i]:
            insort(open_, (unused - sizes[i], b))
    return where


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER, window_rows: int = 50_000) -> DataFrame:
    """(doc_id, piece, n_tokens, container): where every text, or every piece of a text above the capacity, goes."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container", T.LongType())])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        used = 0
        ids: list[int] = []
        pieces: list[int] = []
        sizes: list[int] = []

        def close() -> pd.DataFrame:
            nonlocal used
            boxes = pack(sizes, capacity)
            out = pd.DataFrame({"doc_id": ids, "piece": pd.array(pieces, dtype="int32"), "n_tokens": pd.array(sizes, dtype="int32"), "container": [base + used + b for b in boxes]})
            used += max(boxes, default=-1) + 1
            ids.clear(), pieces.clear(), sizes.clear()
            return out

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                size, piece = len(enc.encode_ordinary(text)), 0
                while size > capacity:
                    ids.append(doc), pieces.append(piece), sizes.append(capacity)
                    size, piece = size - capacity, piece + 1
                ids.append(doc), pieces.append(piece), sizes.append(size)
            if len(ids) >= window_rows:
                yield close()
        if ids:
            yield close()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).mapInPandas(fill, schema)
