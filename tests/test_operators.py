import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, decide, diff, features, group, metrics, models, ranks, translit
from kinloom.operators.diff import NUMBER_RELATIONS, extra_words, number_relation
from kinloom.operators.skew import heavy_keys, tree_aggregate
from kinloom.params import BlockingParams, DecisionParams
from kinloom.session import materialize
from kinloom.sources import io
from kinloom.streaming import incremental


def test_tree_aggregate_matches_counting(spark, rows):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 6 + [None, "", *map(str, range(50))]), rnd.choice([None, 1.0, 2.5]), i) for i in range(5000)]
    df = rows(data, "k string, v double, n_rows int").repartition(7)
    got = {r["k"]: tuple(r)[1:] for r in tree_aggregate(df, ["k"], "v", chunk_rows=100, fan_in=3).collect()}
    want = {}
    for k, v, _ in data:
        want.setdefault(k, []).append(v)
    assert {k: x[0] for k, x in got.items()} == {k: len(v) for k, v in want.items()}
    for k, vs in want.items():
        some = [v for v in vs if v is not None]
        assert got[k][1:] == (len(some), pytest.approx(sum(some)) if some else None, min(some, default=None), max(some, default=None))
    assert {r["key_text"] for r in heavy_keys(df, "k", 0.02, chunk_rows=100).collect()} == {k for k, v in want.items() if k and len(v) >= 100}


def test_tree_aggregate_of_nothing(rows):
    df = rows([], "k string")
    assert tree_aggregate(df, ["k"]).collect() == [] and heavy_keys(df, "k").collect() == []
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], fan_in=1)


def records(rows):
    data = [
        ("S1a", "US", 1, "blue river bakery", "", "12 elm st dallas", "12"),
        ("S1b", "US", 1, "red stone foods", "", "99 oak ave tulsa", "99"),
        ("S2a", "US", 0, "blue river bakry", "", "12 elm st dallas", "12"),
        ("S2b", "India", 0, "blue river bakery", "", "12 elm st dallas", "12"),
        ("S3c", "US", 0, "", "", "", ""),
    ]
    return rows(data, "id string, country string, side int, n_core string, n_alt string, a_norm string, a_nums string")


def test_candidates_stay_in_the_country(rows):
    got = blocking.candidates(records(rows)).collect()
    assert {(r["s1"], r["o"]) for r in got} == {("S1a", "S2a")}
    assert got[0]["r_o"] == 1 and got[0]["rel_o"] == 1.0


def test_budgets_and_caps(rows):
    keys = blocking.block_keys(records(rows))
    rare = blocking.rare_keys(keys, blocking.key_stats(keys), BlockingParams(nk1=1, na1=1, ng1=1))
    most = rare.filter("side = 1").groupBy("id", "typ").count().agg(F.max("count")).first()[0]
    assert most == 1


def test_one_owner_and_lists(rows):
    e = rows([("a", "x", 0.9), ("b", "x", 0.9), ("b", "y", 0.4), ("c", "z", 0.8)], "s1 string, o string, p double")
    assert {(r["s1"], r["o"]) for r in decide.one_owner(e, 0.5).collect()} == {("a", "x"), ("c", "z")}
    ids = rows([("a",), ("b",), ("d",)], "s1 string")
    assert {tuple(r) for r in decide.id_lists(decide.one_owner(e, 0.5), ids).collect()} == {("a", "x"), ("b", ""), ("d", "")}
    assert decide.threshold_of(None, {"threshold": 0.6}) == 0.6 and decide.threshold_of(0.7, None) == 0.7 and decide.threshold_of(None, None) == 0.775


def test_metric_forms_agree(spark, rows):
    rnd = random.Random(3)
    ids = [f"s{i}" for i in range(30)]
    true = {(rnd.choice(ids[:20]), f"o{j}") for j in range(40)}
    best = [(rnd.choice(ids), f"o{j}", round(rnd.random(), 3)) for j in range(60)]
    scores, truth, all_ids = rows(best, "s1 string, o string, p double"), rows(sorted(true), "s1 string, o string"), rows([(i,) for i in ids], "s1 string")
    swept = {r["threshold"]: r["macro_f05"] for r in metrics.sweep(scores, truth, all_ids).collect()}
    assert set(swept) == set(DecisionParams().grid)
    for t in (0.3, 0.5, 0.95):
        kept = {(s, o) for s, o, p in best if p >= t}
        want = sum(metrics.f05({o for s, o in kept if s == i}, {o for s, o in true if s == i}) for i in ids) / len(ids)
        assert swept[t] == pytest.approx(want, abs=1e-6)
        assert metrics.macro_f05(decide.one_owner(scores, t), truth, all_ids).first()["macro_f05"] == pytest.approx(want, abs=1e-6)


def test_siblings(rows):
    e = rows([("a", "x", 0.9), ("a", "y", 0.8), ("b", "z", 0.1), ("b", "w", 0.005), ("c", "x", 0.5), ("c", "z", 0.4)], "s1 string, o string, p double")
    r = rows([("x", "blue river", "12 elm"), ("y", "blue river", "12 elm"), ("z", "blue rivers", "")], "o string, n_core string, a_norm string")
    got = {(x["s1"], x["o"]): x for x in group.siblings(e, r).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "z"), ("c", "x"), ("c", "z")}  # 0.005 is not plausible
    x = got["a", "x"]
    assert (x["sib_n"], x["sib_close"], x["sib_nm_max"], x["sib_both_max"], x["sib_close_p"], x["sib_wsim"]) == (1, 1, 100.0, 100.0, 0.8, 100.0)
    assert (got["b", "z"]["sib_n"], got["b", "z"]["sib_close"], got["b", "z"]["sib_nm_max"]) == (0, 0, None)
    x = got["c", "x"]  # the sibling has no address: not alike at all there
    assert x["sib_nm_max"] > 90 and (x["sib_ad_max"], x["sib_both_max"], x["sib_close"], x["sib_close_p"], x["sib_wsim"]) == (0.0, 0.0, 0, 0.0, 0.0)


def test_twins_count_records_of_the_other_side_only(rows):
    data = [("S1a", 1, "US", "blue river", "12"), ("S2a", 0, "US", "blue river", "12"), ("S2b", 0, "India", "blue river", "12 3"), ("S3a", 0, "US", "blue river", "")]
    got = {r["id"]: (r["twin_name"], r["twin_key"]) for r in group.twins(rows(data, "id string, side int, country string, n_core string, a_nums string")).collect()}
    assert got == {"S2a": (2, 1), "S2b": (2, 1), "S3a": (2, 0)}


@pytest.mark.parametrize("most", [3, 1000])
def test_ranks_of_hot_groups_over_several_ranges(rows, most):
    rnd = random.Random(9)
    data = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randrange(20), i) for i in range(400)]
    got = {(r["k"], r["i"]): r["rank"] for r in ranks.ranked(rows(data, "k string, v int, i int"), "k", [F.desc("v"), F.asc("i")], "rank", most).collect()}
    want = {}
    for key in {k for k, _, _ in data}:
        for n, (_, v, i) in enumerate(sorted((x for x in data if x[0] == key), key=lambda x: (-x[1], x[2])), 1):
            want[key, i] = n
    assert got == want


def test_blend_features(rows):
    e = rows([("a", "x", 0.9, 2.0), ("b", "x", 0.4, 3.0), ("a", "y", 0.5, -1.0)], "s1 string, o string, p double, ce double")
    got = {(r["s1"], r["o"]): tuple(r[c] for c in group.BLEND[1:]) for r in group.blend_features(e).collect()}
    assert got["a", "x"] == (2.0, 3.0, 2, -1.0, 0.0, 2.0, 2.0, 0.5, 0.0) and got["a", "y"] == (-1.0, -1.0, 1, 0.0, 0.0, -20.0, 2.0, 0.5, -3.0)


def test_coverages(rows):
    recs = rows([("s", 1, "blue river blue", "12 elmwood"), ("o", 0, "blue rivr co", ""), ("q", 0, "", "12 elmwod")], "id string, side int, n_core string, a_norm string")
    pairs = rows([("s", "o"), ("s", "q")], "s1 string, o string")
    weights = [features.token_weights(recs, c, features.document_frequencies(recs, c)) for c in ("n_core", "a_norm")]
    got = {r["o"]: r.asDict() for r in features.coverages(pairs, *weights).collect()}
    assert got["o"]["nm_fcov"] == 1.0 and got["o"]["nm_wcov"] == 1.0 and 0 < got["o"]["nm_wexact"] < 1 and got["o"]["nm_fcov_o"] == round(2 / 3, 6) and got["o"]["ad_fcov"] is None
    assert got["q"]["nm_fcov"] is None and got["q"]["nm_wcov_o"] is None and got["q"]["ad_fcov"] == 1.0 and got["q"]["ad_fcov_o"] == 1.0


def test_number_relations(rows):
    data = [("12", "12"), ("", "3"), ("123", "23"), ("123", "12"), ("23", "123"), ("12", "123"), ("123", "923"), ("123", "193"), ("123", "129"), ("1234", "1324"), ("12", "345")]
    df = rows(data, "a string, b string")
    assert [NUMBER_RELATIONS[r[0]] for r in df.select(number_relation(F.col("a"), F.col("b"))).collect()] == NUMBER_RELATIONS


def test_extra_words(rows):
    df = rows([("blue river bakery", "blue rivr north"), ("", "x"), ("x", "")], "a string, b string")
    got = [(r["x_words"], r["d_words"]) for r in extra_words(df, "a", "b").collect()]
    assert got == [(["north"], ["bakery"]), (["x"], []), ([], ["x"])]


def test_extra_words_of_four_kinds_and_their_features(rows):
    ddl = "s1 string, o string, c1 string, co string, d1 string, do string, m1 string, mo string, label long, fold int"
    df = rows([("a", "x", "blue river bakery", "blue rivr north", "12 elm street", "14 elm lane", "12", "14", 1, 0), ("a", "y", "blue", "", "12 elm", "", "12", "", 0, 0)], ddl)
    x = diff.extra_by_kind(df)
    assert [(r["nx"], r["nd"], r["ax"], r["ad"]) for r in x.orderBy("o").collect()] == [(["north"], ["bakery"], ["lane"], ["street"]), ([], [], [], [])]
    scored = diff.crossfit_scores(x, diff.KINDS)
    assert {(r["kind"], r["token"]) for r in scored.collect()} == {("n_core", "north"), ("n_core_d", "bakery"), ("a_norm", "lane"), ("a_norm_d", "street")}
    got = {r["o"]: r.asDict() for r in diff.pair_features(df.join(x.select("s1", "o", "nx", "nd", "ax", "ad"), ["s1", "o"]), scored).collect()}
    assert len(got["x"]) == 18 and got["x"]["ad_d_n"] == 1 and got["x"]["ad_x_min"] == 0.02 and got["x"]["nm_first_eq"] == 1 and got["x"]["num_x_n"] == 1
    assert got["y"]["ad_x_n"] is None and got["y"]["nm_x_min"] == 1.0 and got["y"]["nm_first_eq"] is None


def test_translit_learns_a_spelling(rows):
    recs = rows(
        [("s1", "US", 1, "vovaji foods", "pune"), ("s2", "US", 1, "vovaji motors", "pune"), ("o1", "US", 0, "वोवजि foods", "pune"), ("o2", "US", 0, "वोवजि motors", "pune")],
        "id string, country string, side int, business_name string, business_address string",
    )
    truth = rows([("s1", "o1"), ("s2", "o2")], "s1 string, o string")
    assert [tuple(r)[:2] for r in translit.learn(truth, recs).collect()] == [("वोवजि", "vovaji")]


def test_models_score_and_reload(spark, rows, tmp_path):
    rnd = random.Random(5)
    data = [(f"s{i}", f"o{i}", float(i % 2) + rnd.random() * 0.5, None if i % 7 == 0 else float(i), i % 2) for i in range(200)]
    df = rows(data, "s1 string, o string, a double, b double, label int")
    b = models.BoostParams(rounds=3, depth=2, least=2)
    got = models.out_of_fold(df, ["a", "b"], b=b)
    assert got.count() == 200
    assert got.filter("(p >= 0.5) = (label = 1)").count() > 190
    model = models.fit(df, ["a", "b"], b)
    path = f"file://{tmp_path}/model"
    models.save(model, path, ["a", "b"], 0.7)
    again, names, threshold = models.load(path)
    assert names == ["a", "b"] and threshold == 0.7
    assert models.importances(again, names)[0][0] == "a"


def test_text_tables_round_trip(spark, rows, tmp_path):
    df = rows([("1", 'say "hi"', "a, b", "US"), ("2", "", "", "US")], "entity_id string, business_name string, business_address string, country string")
    path = f"file://{tmp_path}/out.tsv"
    io.write_tsv(df, path, "entity_id")
    assert [tuple(r) for r in io.read_table(spark, path, io.RECORD).orderBy("entity_id").collect()] == [tuple(r) for r in df.collect()]
    built = []
    for _ in range(2):
        got = io.stage(spark, f"file://{tmp_path}/stage", lambda: built.append(1) or df)
    assert len(built) == 1 and got.count() == 2
    io.write_json(spark, f"file://{tmp_path}/j", {"é": [1, 2]})
    assert io.read_json(spark, f"file://{tmp_path}/j") == {"é": [1, 2]}
    truth = rows([("a", "x, y"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    assert {tuple(r) for r in io.explode_truth(truth).collect()} == {("a", "x"), ("a", "y")}
    numbered = ranks.numbered(df.select("entity_id"), ["entity_id"]).collect()
    assert sorted((r["entity_id"], r["row"]) for r in numbered) == [("1", 0), ("2", 1)]


def test_stream_finds_owners(spark, rows, tmp_path):
    recs = records(rows).drop("side")
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    recs.filter("id like 'S2%' or id like 'S3%'").write.parquet(src)
    keys = incremental.register_keys(recs.filter("id like 'S1%'"))
    stream = spark.readStream.schema(recs.schema).parquet(src)
    q = incremental.start(stream, keys, out, f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r["o"], r["s1"]) for r in spark.read.parquet(out).collect()} == {("S2a", "S1a")}


def test_scratch_tables_go_and_kept_ones_stay(spark, rows):
    from kinloom.session import materialize, scratch

    with scratch(spark):
        inner = materialize(rows([(1,)], "a int"), "inner")
        kept = materialize(inner, "kept", keep=True)
    assert kept.collect()[0]["a"] == 1
    with pytest.raises(Exception, match="(?i)not exist|does not|FILE_NOT"):
        inner.collect()


def test_written_tables_leave_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if "shuffle_" in f}

    before = held()
    written = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not held() - before and written.count() == 10


def test_scores_by_parts_are_those_of_one_plan_and_leave_only_the_result(spark):
    import os

    from kinloom.plans.records import records
    from kinloom.session import shared_dir

    recs = records(spark, "/root/testdata/sf0.001")
    keys = blocking.block_keys(recs)
    composites = blocking.composite_keys(blocking.rare_keys(keys, blocking.key_stats(keys)))
    plain = blocking.pair_scores(composites, blocking.composite_weights(composites))
    folder = shared_dir(spark).removeprefix("file://") + "/kinloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    want = sorted(map(tuple, plain.collect()))
    for parts in (1, 3):
        got = blocking.scored(recs, whole=10, parts=parts)
        assert sorted(map(tuple, got.collect())) == want and want
        # one table, whose plan has neither the records nor the keys any more
        assert "Exchange" not in got._jdf.queryExecution().toString()
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"pair-scores"}
    assert blocking.scored(recs.limit(0), whole=0).collect() == []
