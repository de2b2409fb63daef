"""Radius join of strings under the edit distance by metric-space partitioning.

Every block of left strings with more than ``cell_rows`` of them is cut into cells: pivots are drawn by hash, one for
``cell_rows`` strings, and every left string goes to the cell of its nearest pivot, at distance k (its ring). Right strings
are replicated to every cell that can hold a partner: for x in the cell of pivot p at distance k and y with d(x, y) <= r, the
triangle inequality gives |d(y, p) - k| <= r and, as k is the distance of x to its *nearest* pivot, k <= near(y) + r. A cell is
sent y only if one of its rings fulfils both. A block gets at most ``pivots`` cells at once; cells that are still large are
cut again, with pivots of their own, so pivots grow with the data and the work per string does not.

Inside a cell every pair is decided by the true distance (bit-parallel, Myers 1999), after two bounds that can only
spare work: the difference of the lengths, and the letters of one string that the other lacks, each at most r. Cells are
compared in packs of bounded size, of a hot cell as many as it needs. No pair within the radius is lost, whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.session import materialize


@dataclass(frozen=True)
class RadiusParams:
    radius: int = 3
    #: Strings shorter than the first number have the second as their radius; the shorter of a pair counts.
    short: tuple[tuple[int, int], ...] = ()
    cell_rows: int = 1024
    pivots: int = 64
    #: Strings of one side in a pack.
    pack_rows: int = 4096
    #: Pivots that are broadcast at once; blocks with more in all are cut in several passes.
    broadcast_pivots: int = 500_000

    def allowed(self, length: np.ndarray) -> np.ndarray:
        out = np.full(len(length), self.radius)
        for below, r in sorted(self.short, reverse=True):
            out = np.where(length < below, min(r, self.radius), out)
        return out


def within(a: str, b: str, limit: int) -> int:
    """Levenshtein distance of strings of any length, limit + 1 beyond the limit (only the band that can stay within it)."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    last = {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            v = last.get(j, limit) + 1
            if j:
                v = min(v, row.get(j - 1, limit) + 1, last.get(j - 1, limit) + (x != b[j - 1]))
            row[j] = v
        if min(row.values()) > limit:
            return limit + 1
        last = row
    return min(last[len(b)], limit + 1)


def codes_of(texts: list[str], width: int) -> np.ndarray:
    """Code points (texts, width) of texts of at most that width, 0 beyond their ends."""
    return np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """The letters of each text as 64 bits: one for the first, second and (of some) third of each kind.

    Bits of one text that another lacks are letters it lacks. Kinds are code points modulo 26, so other scripts share them.
    """
    kind = np.where(codes == 0, 255, (codes.astype(np.int64) - 97) % 26).astype(np.uint8)
    out = np.zeros(len(codes), dtype=np.uint64)
    for k in range(26):
        n = (kind == k).sum(axis=1)
        out |= (n >= 1).astype(np.uint64) << np.uint64(k)
        out |= (n >= 2).astype(np.uint64) << np.uint64(26 + k)
        if k < 12:
            out |= (n >= 3).astype(np.uint64) << np.uint64(52 + k)
    return out


class Patterns:
    """Strings of at most 63 code points, laid out for bit-parallel distances to others."""

    def __init__(self, words: list[str]) -> None:
        self.length = np.array([len(w) for w in words], dtype=np.int32)
        width = int(self.length.max()) if words else 1
        self.word = np.uint32 if width < 32 else np.uint64
        codes = codes_of(words, width)
        self.letters = np.unique(codes[codes > 0])
        self.table = np.zeros((len(self.letters) + 1, len(words)), dtype=self.word)
        at = np.searchsorted(self.letters, codes) + 1
        for i in range(width):
            some = np.nonzero(codes[:, i])[0]
            self.table[at[some, i], some] |= self.word(1 << i)
        self.top = (np.maximum(self.length, 1) - 1).astype(self.word)

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table for code points; row 0 stands for letters that no pattern has."""
        at = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == codes if len(self.letters) else np.zeros(codes.shape, dtype=bool)
        return np.where(known, at + 1, 0)

    def distances(self, encoded: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distances of texts ``i`` to patterns ``j``, in lanes of pairs (Myers 1999, Hyyro 2003)."""
        out = np.empty(len(i), dtype=np.int32)
        order = np.argsort(-lengths[i], kind="stable")
        for start in range(0, len(order), 16_384):
            part = order[start : start + 16_384]
            out[part] = self._lanes(encoded, lengths, i[part], j[part])
        return out

    def _lanes(self, encoded: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        one = self.word(1)
        size = lengths[i]
        pv, mv = np.full(len(i), ~self.word(0), dtype=self.word), np.zeros(len(i), dtype=self.word)
        score, top = self.length[j].astype(np.int32), self.top[j]
        n = len(i)
        for t in range(int(size[0]) if n else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # texts come longest first; those that ended keep their score
            eq, p, m = self.table[encoded[i[:n], t], j[:n]], pv[:n], mv[:n]
            xv = eq | m
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            score[:n] += ((ph >> top[:n]) & one).astype(np.int32) - ((mh >> top[:n]) & one).astype(np.int32)
            ph, mh = (ph << one) | one, mh << one
            pv[:n], mv[:n] = mh | ~(xv | ph), ph & xv
        return score


def pairs_within(left: list[str], right: list[str], params: RadiusParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left position, right position, distance) of all pairs within the radius of the shorter."""
    none = np.zeros(0, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    r = params.radius
    ll, rl = (np.array([len(t) for t in x], dtype=np.int64) for x in (left, right))
    for low, high in ((0, 31), (31, 63)):
        own = np.nonzero((ll > low) & (ll <= high))[0]
        near = np.nonzero((rl > max(0, low - r)) & (rl <= high + r))[0]
        if not len(own) or not len(near):
            continue
        texts = [left[k] for k in own]
        a, b = codes_of(texts, high), codes_of([right[k] for k in near], high + r)
        sa, sb = letter_counts(a), letter_counts(b)
        patterns = Patterns(texts)
        encoded = patterns.encode(b)
        lacks, step = ~sa, max(1, 2_000_000 // len(own))
        for k in range(0, len(near), step):
            few = near[k : k + step]
            # in blocks that stay in a core's cache
            block = max(1, 65_536 // len(own))
            at = [np.flatnonzero(np.bitwise_count(sb[m : min(m + block, k + step), None] & lacks) <= r) + (m - k) * len(own) for m in range(k, k + len(few), block)]
            i, j = np.divmod(np.concatenate(at), len(own))
            ok = (np.abs(rl[few][i] - ll[own][j]) <= r) & (np.bitwise_count(sa[j] & ~sb[k + i]) <= r)
            i, j = i[ok], j[ok]
            if len(i):
                d = patterns.distances(encoded[k : k + step], rl[few], i, j)
                ok = d <= params.allowed(np.minimum(rl[few][i], ll[own][j]))
                found.append((own[j[ok]], few[i[ok]], d[ok]))
    long = np.nonzero(ll > 63)[0]
    if len(long):
        order = np.argsort(rl, kind="stable")
        for k in long:
            lo, hi = np.searchsorted(rl[order], [ll[k] - r, ll[k] + r + 1])
            for m in order[lo:hi]:
                d = within(left[k], right[m], r)
                if d <= params.allowed(np.array([min(ll[k], rl[m])]))[0]:
                    found.append((np.array([k]), np.array([m]), np.array([d])))
    if not found:
        return none, none, none.astype(np.int32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


POINT = T.StructType([T.StructField("block", T.StringType()), T.StructField("text", T.StringType()), T.StructField("id", T.LongType()), T.StructField("tag", T.StringType())])


def _pivot_distances(blocks: pa.Array, texts: pa.Array, pivots: dict[str, list[str]], made: dict[str, Patterns], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(rows, distances to all pivots, block) for the rows of each block that is cut; of no use for texts longer than ``width``."""
    coded = blocks.dictionary_encode() if not isinstance(blocks, pa.DictionaryArray) else blocks
    index = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(index, kind="stable")
    ends = np.searchsorted(index[order], np.arange(len(coded.dictionary) + 1))
    words_of = np.array(texts.to_pylist(), dtype=object)
    for k, block in enumerate(coded.dictionary.to_pylist()):
        words = pivots.get(block)
        if not words:
            continue
        if block not in made:
            made[block] = Patterns(words)
        at = order[ends[k] : ends[k + 1]]
        own = words_of[at].tolist()
        lengths = np.array([min(len(t), width) for t in own], dtype=np.int64)
        d = np.zeros((len(at), len(words)), dtype=np.int32)
        encoded = made[block].encode(codes_of([t[:width] for t in own], int(lengths.max())))
        i, j = np.divmod(np.arange(len(at) * len(words)), len(words))
        d[i, j] = made[block].distances(encoded, lengths, i, j)
        yield at, d, block


#: Texts beyond this length stay out of the cells: they form one of their own in each block.
LONGEST = 120


def _cut(lp: DataFrame, rp: DataFrame, params: RadiusParams, limit: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Both sides with the blocks of more than ``limit`` left strings cut into cells, and the rows of the largest cell; None if there are none."""
    spark, r = lp.sparkSession, params.radius
    large = materialize(lp.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > limit), "large")
    total = large.agg(F.sum(F.least(F.lit(params.pivots), F.ceil(F.col("n") / params.cell_rows))).alias("p")).first()["p"]
    if not total:
        return None
    passes = -(-int(total) // params.broadcast_pivots)
    lefts, rights, largest = [], [], 0
    for k in range(passes):
        some = large.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == k)
        spot = F.xxhash64("text")
        # a share of each block by hash, the same in every run, somewhat more than needed; the exact cut follows on the driver
        wanted = F.least(F.lit(params.pivots), F.ceil(F.col("n") / params.cell_rows))
        share = (wanted * 1.5 + 20) / F.col("n")
        drawn = lp.filter(F.length("text").between(1, 63)).join(F.broadcast(some), "block").filter(F.pmod(spot, F.lit(1_000_003)) < share * 1_000_003)
        rows = drawn.select("block", "text", wanted.alias("w"), spot.alias("s")).distinct().toPandas().sort_values(["block", "s", "text"])
        pivots = {b: x["text"].tolist()[: int(x["w"].iloc[0])] for b, x in rows.groupby("block")}
        for row in some.select("block").toLocalIterator():  # bounded as the pivots are
            pivots.setdefault(row["block"], [""])  # nothing to draw from: every string is as near to it as any other
        held = spark.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            made: dict[str, Patterns] = {}
            for batch in batches:
                cell, ring = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int32)
                for at, d, _ in _pivot_distances(batch["block"], batch["text"], held.value, made, LONGEST + r):
                    best = d.argmin(axis=1)
                    cell[at], ring[at] = best, d[np.arange(len(at)), best]
                cell = np.where(pc.utf8_length(batch["text"]).to_numpy() > LONGEST, -1, cell).astype(np.int32)
                ring = np.left_shift(np.int64(1), np.minimum(ring, 62).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring)], [*POINT.names, "cell", "ring"])

        shape = T.StructType([*POINT.fields, T.StructField("cell", T.IntegerType()), T.StructField("ring", T.LongType())])
        own = materialize(lp.join(F.broadcast(some.select("block")), "block", "left_semi").select(*POINT.names).mapInArrow(assign, shape), "cells")
        # rings present in each cell, one bit each; bounded by the pivots
        rings: dict[str, np.ndarray] = {b: np.zeros(len(p) + 1, dtype=np.uint64) for b, p in pivots.items()}
        for row in own.groupBy("block", "cell").agg(F.bit_or("ring").alias("m"), F.count("*").alias("n")).toLocalIterator():
            rings[row["block"]][row["cell"]] = np.uint64(row["m"])
            largest = max(largest, row["n"])
        seen = spark.sparkContext.broadcast(rings)

        def replicate(batches: Iterator[pa.RecordBatch], held=held, seen=seen) -> Iterator[pa.RecordBatch]:
            made: dict[str, Patterns] = {}
            one = np.uint64(1)
            for batch in batches:
                size = pc.utf8_length(batch["text"]).to_numpy()
                rows, cells = [], []
                for at, d, block in _pivot_distances(batch["block"], batch["text"], held.value, made, LONGEST + r):
                    masks = seen.value[block]
                    low = np.maximum(d - r, 0)
                    high = np.minimum(d.min(axis=1, keepdims=True) + r, 62)
                    span = (np.left_shift(one, np.minimum(high + 1, 63).astype(np.uint64)) - one) & ~(np.left_shift(one, np.minimum(low, 63).astype(np.uint64)) - one)
                    # rings beyond the bits share the last one
                    sent = ((span & masks[None, :-1]) != 0) | ((low > 62) & ((masks[None, :-1] >> np.uint64(62)) > 0))
                    i, j = np.nonzero(sent & (size[at] <= LONGEST + r)[:, None])
                    rows.append(at[i])
                    cells.append(j)
                    far = at[size[at] > LONGEST - r] if masks[-1] else at[:0]
                    rows.append(far)
                    cells.append(np.full(len(far), -1))
                row, cell = np.concatenate(rows), np.concatenate(cells).astype(np.int32)
                order = np.argsort(row, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cell[order]))], [*POINT.names, "chunk", "cells"])

        there = rp.join(F.broadcast(some.select("block")), "block", "left_semi").select(*POINT.names, "chunk")
        sent = there.mapInArrow(replicate, T.StructType([*POINT.fields, T.StructField("chunk", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))
        lefts.append(own.withColumn("block", F.concat_ws("/", "block", F.col("cell").cast("string"))).select(*POINT.names))
        rights.append(sent.withColumn("cell", F.explode("cells")).select(F.concat_ws("/", "block", F.col("cell").cast("string")).alias("block"), "text", "id", "tag", "chunk"))
    lp, rp = (x.join(large.select("block"), "block", "left_anti") for x in (lp, rp))
    for a, b in zip(lefts, rights, strict=True):
        lp, rp = lp.unionByName(a), rp.unionByName(b)
    return lp, rp, largest


def radius_join(left: DataFrame, right: DataFrame, params: RadiusParams = RadiusParams()) -> DataFrame:
    """(left_id, right_id, left_tag, right_tag, distance) for all pairs of one block within the radius.

    Both sides have ``block`` (string), ``text`` (string), ``id`` (bigint) and ``tag`` (string, carried). NULL and empty
    texts, and NULL blocks, join nothing; texts of any length are compared whole; either side may be empty. Rows must be
    distinct; they are read several times.
    """

    def points(df: DataFrame) -> DataFrame:
        return df.select(*POINT.names).filter((F.col("text") != "") & F.col("block").isNotNull())

    lp, rp = points(left), points(right)
    packs = rp.groupBy("block").agg(F.ceil(F.count("*") / params.pack_rows).cast("int").alias("packs"))
    rp = rp.join(packs, "block").withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.col("packs")).cast("int")).drop("packs")
    limit = params.cell_rows
    for _ in range(6):
        cut = _cut(lp, rp, params, limit)
        if cut is None:
            break
        lp, rp, largest = cut
        limit = 4 * params.cell_rows  # what is not much larger than a cell is left alone
        if largest <= limit:
            break
    entry = F.struct("text", "id", "tag")
    few = lp.groupBy("block").agg(F.ceil(F.count("*") / params.pack_rows).cast("int").alias("packs"))
    ours = lp.join(few, "block").withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.col("packs"))).groupBy("block", "chunk").agg(F.collect_list(entry).alias("ours")).drop("chunk")
    theirs = rp.groupBy("block", "chunk").agg(F.collect_list(entry).alias("theirs")).drop("chunk")
    columns = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("ours", "theirs") for c in ("text", "id", "tag")]
    cells = ours.join(theirs, "block").select(*columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ours, theirs = ([batch[f"{s}_{c}"][k].values for c in ("text", "id", "tag")] for s in ("ours", "theirs"))
                i, j, d = pairs_within(ours[0].to_pylist(), theirs[0].to_pylist(), params)
                if len(i):
                    i, j = pa.array(i), pa.array(j)
                    yield pa.RecordBatch.from_arrays([ours[1].take(i), theirs[1].take(j), ours[2].take(i), theirs[2].take(j), pa.array(d.astype(np.int32))], out.names)

    out = T.StructType([T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType()), T.StructField("left_tag", T.StringType()), T.StructField("right_tag", T.StringType()), T.StructField("distance", T.IntegerType())])
    return cells.mapInArrow(compare, out)
