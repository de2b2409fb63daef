"""Problem 5: matching entities across sources without keys, by a label model.

Candidates are all pairs of an S1 row and a record at the same premises (``premises``) whose trades and parent-body words do not
contradict, whatever their names; and, where a side has no usable address, the pairs of one organisation
(``organisations``) that has a single S1 row. Matching functions vote on every candidate, each on one look at the names or
addresses: for, weakly for, not applicable (which says nothing), against. Votes are counted by pattern, so the model sees a
table whose size depends on the number of functions and not on the data. It is generative: given match or no match, votes follow
tables learned by expectation maximisation without labels (a weak prior says that every function is better than chance),
first as if independent, then along the tree of the strongest correlations (a spanning tree by conditional mutual
information), so that functions that err together do not count twice. The posterior is the confidence of a match, and
decides; no vote is a veto. What excludes a pair before the vote is only what the problem states: another trade, parent body, house
number, kind of street or compass part. A record of the other sources keeps its best S1 row.

Defined results: S1 rows without a name match nothing, nor do records without one; missing addresses leave the
organisation to decide; ties in confidence go to the nearer name, then to the smaller S1 id; repeated deliveries count
once; columns other than the four named ones are ignored; an empty side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import organisations, premises
from kinloom.llm.records import core, read_records, swapped
from kinloom.session import materialize, scratch

FUNCTIONS = ("name", "share", "letters", "first", "last", "given", "trade", "street", "postcode", "town", "state")
FOR, WEAK, ABSENT, AGAINST = 0, 1, 2, 3


@dataclass
class LabelModel:
    """P(votes | match or not) as a tree of tables, with the prior of a match."""

    prior: float
    parent: list[int]
    tables: list[np.ndarray]  # [class, vote of parent, vote]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for f, (p, t) in enumerate(zip(self.parent, self.tables, strict=True)):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=np.int64)
            # a function that does not apply says nothing, not even by its silence
            log += np.where(votes[:, [f]] == ABSENT, 0.0, np.log(t[:, above, votes[:, f]].T))
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(axis=1)


#: What is believed of any function before it is seen at work, of pairs that do not and that do match: votes for, weakly for, against.
BETTER_THAN_CHANCE = np.array([[0.15, 0.15, 0.0, 0.70], [0.60, 0.35, 0.0, 0.05]])


def _tables(votes: np.ndarray, weight: np.ndarray, q: np.ndarray, parent: list[int], smooth: float, belief: float = 0.002) -> list[np.ndarray]:
    out = []
    mass = max(20.0, belief * weight.sum())
    for f, p in enumerate(parent):
        above = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=np.int64)
        t = np.full((2, 4, 4), smooth)
        # a sparse cell leans on the function's own table rather than on a flat one
        for c, r in ((0, 1 - q), (1, q)):
            own = np.bincount(votes[:, f], weights=weight * r, minlength=4) + smooth
            own[ABSENT] = 0
            own = own + mass * BETTER_THAN_CHANCE[c]
            t[c] += 4 * own / own.sum() + mass * BETTER_THAN_CHANCE[c]
            np.add.at(t[c], (above, votes[:, f]), weight * r)
        t[:, :, ABSENT] = 1e-9
        out.append(t / t.sum(axis=2, keepdims=True))
    return out


def fit_label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 40, smooth: float = 0.5) -> LabelModel:
    """Learns accuracies and correlations of the functions from vote patterns (rows) and their counts."""
    n_f = votes.shape[1]

    def start(trust: np.ndarray) -> np.ndarray:
        said = 1.0 * (votes == FOR) + 0.5 * (votes == WEAK) - 1.5 * (votes == AGAINST)
        return 1 / (1 + np.exp(-(said * trust).sum(axis=1)))

    def run(q: np.ndarray, parent: list[int], times: int) -> tuple[np.ndarray, LabelModel]:
        for _ in range(times):
            prior = float(np.clip((weight * q).sum() / weight.sum(), 0.01, 0.99))
            model = LabelModel(prior, parent, _tables(votes, weight, q, parent, smooth))
            q = model.posterior(votes)
        return q, model

    # a few rounds as if independent show which functions err together; the rest starts anew, with a function that
    # repeats its parent trusted less, lest repeated votes settle the classes by themselves
    q, model = run(start(np.ones(n_f)), [-1] * n_f, 5)
    for _ in range(4):
        parent, strength = correlation_tree(votes, weight, q)
        q, model = run(start(1 - strength), parent, rounds)
    return model


#: Share of a function's information, given the class, from which on its link to its parent is kept.
LINK = 0.1


def correlation_tree(votes: np.ndarray, weight: np.ndarray, q: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Parents in the spanning tree of greatest mutual information of votes, given the class (-1: none, or a weak one), and the
    share of each function's own information that its parent has already."""
    n_f = votes.shape[1]
    info = np.zeros((n_f, n_f))
    own, shared = np.zeros(n_f), np.zeros((n_f, n_f))
    for a in range(n_f):
        p = np.bincount(votes[:, a], weights=weight, minlength=4) / weight.sum()
        own[a] = -(p[p > 0] * np.log(p[p > 0])).sum()
    total = weight.sum()
    for a in range(n_f):
        for b in range(a + 1, n_f):
            for r in (1 - q, q):
                joint = np.zeros((4, 4))
                np.add.at(joint, (votes[:, a], votes[:, b]), weight * r)
                mass = joint.sum()
                if mass <= 0:
                    continue
                joint /= mass
                outer = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                at = joint > 0
                info[a, b] += mass / total * (joint[at] * np.log(joint[at] / outer[at])).sum()
            both = np.zeros((4, 4))
            np.add.at(both, (votes[:, a], votes[:, b]), weight / total)
            outer = both.sum(axis=1, keepdims=True) * both.sum(axis=0, keepdims=True)
            shared[a, b] = shared[b, a] = (both[both > 0] * np.log(both[both > 0] / outer[both > 0])).sum()
            # functions that always say the same have nothing left once the class is given; what they share at all decides then
            info[a, b] = info[b, a] = info[a, b] + 1e-3 * shared[a, b]
    parent = [-1] * n_f
    inside = {0}
    while len(inside) < n_f:
        a, b = max(((a, b) for a in inside for b in range(n_f) if b not in inside), key=lambda x: info[x])
        parent[b] = a
        inside.add(b)
    # a weak link explains little and could take the class's place: such functions stand alone
    parent = [p if p >= 0 and info[b, p] >= LINK * own[b] else -1 for b, p in enumerate(parent)]
    strength = np.array([min(1.0, shared[b, p] / own[b]) if p >= 0 and own[b] > 0 else 0.0 for b, p in enumerate(parent)])
    return parent, strength


def _vote(left: Column, right: Column, weak: Column) -> Column:
    return F.when((left == "") | (right == ""), ABSENT).when(left == right, FOR).when(weak, WEAK).otherwise(AGAINST)


def _packed(votes: dict[str, Column]) -> Column:
    """The votes of some functions as one number, two bits each at their place in ``FUNCTIONS``."""
    return sum((F.shiftleft(v.cast("int"), 2 * FUNCTIONS.index(f)) for f, v in votes.items()), F.lit(0))


def name_votes(pairs: DataFrame) -> DataFrame:
    """Adds ``v_name``, the packed votes on the names, and ``edits``, the edits between them in their better order."""
    a, b, t = core("l_words"), core("r_words"), swapped("r_words")
    # the smallest bound that holds decides: equal names, the most of them, and near ones cost no whole comparison of letters
    within = lambda x, y, k: F.nullif(F.levenshtein(x, y, k), F.lit(-1))
    pairs = pairs.withColumn("straight", F.when(a == b, 0).otherwise(F.coalesce(within(a, b, 3), F.levenshtein(a, b))))
    turned = F.when(F.col("straight") <= 3, within(a, t, 2)).otherwise(F.levenshtein(a, t))
    edits = F.least("straight", F.when((F.col("straight") == 0) | (t == ""), F.lit(10_000)).otherwise(F.coalesce(turned, F.lit(10_000))))
    pairs = pairs.withColumns({"edits": edits, "size": F.greatest(F.length(a), F.length(b))})
    sorted_ = lambda c: F.array_join(F.sort_array(F.split(c, "")), "")
    # (the letters are looked at only where the names differ)
    pairs = pairs.withColumns({"jumbled": F.when(F.col("edits") == 0, 0).otherwise(F.levenshtein(sorted_(a), sorted_(b))), "other": F.when(F.col("straight") <= F.col("edits"), b).otherwise(t)})
    jumbled, other = F.col("jumbled"), F.col("other")
    # the beginnings and the ends of the names, in the order in which they are nearer
    near = lambda x, y: F.when(x == y, FOR).when(F.levenshtein(x, y, 2) >= 0, WEAK).otherwise(AGAINST)
    votes = {
        "name": F.when(F.col("edits") == 0, FOR).when(F.col("edits") <= 2, WEAK).otherwise(AGAINST),
        "share": F.when(F.col("edits") <= F.col("size") * 0.15, FOR).when(F.col("edits") <= F.col("size") * 0.4, WEAK).otherwise(AGAINST),
        # letters whatever their order: transposed ones cost nothing
        "letters": F.when(jumbled <= 1, FOR).when(jumbled <= F.col("size") * 0.3, WEAK).otherwise(AGAINST),
        "first": near(F.substring(a, 1, 6), F.substring(other, 1, 6)),
        "last": near(F.substring(a, -6, 6), F.substring(other, -6, 6)),
        "given": _vote(F.col("l_given"), F.col("r_given"), organisations.given_agree("l_given", "r_given")),
        "trade": _vote(F.col("l_trade"), F.col("r_trade"), F.lit(False)),
    }
    return pairs.withColumn("v_name", _packed(votes)).drop("size", "straight", "jumbled", "other")


def address_votes(left: str, right: str) -> Column:
    """The packed votes on addresses whose parts have these prefixes."""
    of = lambda c: (F.col(left + c), F.col(right + c))
    close = lambda c, k: (F.levenshtein(*of(c), k) >= 0) & (F.least(*(F.length(x) for x in of(c))) >= 4)
    return _packed({
        "street": _vote(*of("street"), close("street", 4)),
        "postcode": _vote(*of("postcode"), F.lit(False)),
        "town": _vote(*of("town"), close("town", 3)),
        "state": _vote(*of("state"), F.lit(False)),
    })


NAMED = ("words", "trade", "given")
LOCATED = ("street", "postcode", "town", "state")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s1, o, v_address, l_..., r_...) candidate pairs of read records with ``ncls``, ``acls`` and ``placed``, as the module's text
    lists them, with the packed votes on their addresses and the parts of their names."""
    placed = lambda df: df.filter("placed").select(F.col("acls").alias("cls"), *premises.CLASS)
    places = premises.match_address_classes(placed(left), placed(right), address_votes("left_", "right_"))
    places = materialize(places.select(F.col("left_cls").alias("acls"), F.col("right_cls").alias("r_acls"), F.col("seen").alias("v_address")), "place-pairs")
    names = materialize(
        organisations.match_name_classes(
            *(x.select(F.col("ncls").alias("cls"), *organisations.CLASS) for x in (left, right)), asked=tuple(x.filter("not placed").select(F.col("ncls").alias("cls")).distinct() for x in (left, right))
        ).select(F.col("left_cls").alias("ncls"), F.col("right_cls").alias("r_ncls")),
        "name-pairs",
    )

    def side(df: DataFrame, mark: str, *cols: str) -> DataFrame:
        return df.select(*cols, *[F.col(p).alias(f"{mark}_{p}") for p in (*NAMED, "parent")])

    here = side(left.filter("placed"), "l", "s1", "acls")
    there = materialize(side(right.filter("placed").withColumnRenamed("acls", "r_acls"), "r", "o", "r_acls").join(places, "r_acls"), "there")
    # those at one premises meet by trade, so that a premises with many trades is no single block; few state none
    stated = here.filter("l_trade <> ''").withColumn("trade", F.col("l_trade")).join(there.filter("r_trade <> ''").withColumn("trade", F.col("r_trade")), ["acls", "trade"])
    together = [stated, here.filter("l_trade = ''").join(there, "acls"), here.filter("l_trade <> ''").join(there.filter("r_trade = ''"), "acls")]
    out = ["s1", "o", "v_address", *[f"{m}_{p}" for m in "lr" for p in NAMED]]
    # an organisation with a single S1 row decides alone where an address is missing
    rows = left.select("ncls", "s1").distinct().groupBy("ncls").agg(F.count("*").alias("n"))
    single = names.join(rows, "ncls").groupBy("r_ncls").agg(F.sum("n").alias("n"), F.min("ncls").alias("ncls")).filter("n = 1").drop("n")
    single = materialize(single, "single")
    ours = left.select("s1", "ncls", "placed", *[F.col(p).alias(f"l_{p}") for p in (*NAMED, *LOCATED)])
    theirs = right.select("o", F.col("ncls").alias("r_ncls"), F.col("placed").alias("r_placed"), *[F.col(p).alias(f"r_{p}") for p in (*NAMED, *LOCATED)])
    # from the side without address, which has few rows, to the other
    few = [materialize(single.join(x, k), "unplaced") for x, k in ((ours.filter("not placed"), "ncls"), (theirs.filter("not r_placed"), "r_ncls"))]
    lone = few[0].join(theirs, "r_ncls").unionByName(few[1].join(ours.filter("placed"), "ncls"))
    pairs = lone.withColumn("v_address", address_votes("l_", "r_")).select(*out)
    for x in together:
        pairs = pairs.unionByName(x.filter("l_parent = r_parent").select(*out))
    return pairs


def link_entities(s1: DataFrame, others: DataFrame, least: float = 0.5) -> DataFrame:
    """(s1, o, confidence): the S1 business of which a record is a copy, at most one for each record."""
    spark = s1.sparkSession

    with scratch(spark):
        read = [materialize(read_records(x, True, True).filter("words <> ''"), "records") for x in (s1, others)]
        learned = organisations.learn_words(*read)
        ids = {"ncls": F.xxhash64(*organisations.CLASS), "acls": F.xxhash64(*premises.CLASS), "placed": (F.col("number") != "") & (F.col("street") != "")}
        # (written, as a dozen steps read them)
        left, right = (materialize(learned.apply(x).withColumns(ids).withColumnRenamed("id", side), "read") for x, side in zip(read, ("s1", "o"), strict=True))
        voted = name_votes(candidates(left, right)).select("s1", "o", "edits", F.col("v_name").bitwiseOR(F.col("v_address")).alias("pattern"))
        voted = materialize(voted, "votes")
        counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # at most 4 ** 11 in theory, some thousands in practice
        known = pa.table({"pattern": pa.array([], pa.int32()), "confidence": pa.array([], pa.float64())})
        if len(counts):
            votes = counts["pattern"].to_numpy()[:, None] >> (2 * np.arange(len(FUNCTIONS))) & 3
            model = fit_label_model(votes, counts["n"].to_numpy(dtype=np.float64))
            known = pa.table({"pattern": pa.array(counts["pattern"].to_numpy(), pa.int32()), "confidence": model.posterior(votes)})
        known = spark.createDataFrame(known)
        best = Window.partitionBy("o").orderBy(F.desc("confidence"), "edits", "s1")
        good = voted.join(F.broadcast(known), "pattern").filter(F.col("confidence") >= least)
        return materialize(good.withColumn("k", F.row_number().over(best)).filter("k = 1").select("s1", "o", "confidence"), "links", keep=True)
