"""The normed_ queries against brute force on a few records that the plain rules cut apart."""

from kinloom.plans import registry

DDL = "entity_id string, business_name string, business_address string, country string"
ACCENTED = [
    ("S1a", "Plépulic Vorétan SARL", "12 Rue de Gédeli, 33100 Lune", "France"),
    ("S1b", "Red Stone Foods Inc", "99 Oakridge Ave, Tulsa, OK 74101", "US"),
    ("S1c", "वोवजि तेदतु", "7 Pinehurst Rd, Pune", "India"),
]
OTHERS = [
    ("S2a", "Plepulic Voretan", "12 rue de Gedeli 33100", "France"),
    ("S2b", "Blue River d/b/a Red Stone Foods", "", "US"),
    ("S2c", "वोवजि तेदतु", "", "India"),
    ("S2c", "वोवजि तेदतु", "", "India"),
]


def keys(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["key"])
    return out


def test_normalised_keys_and_owners(rows, spark, tmp_path):
    for name, data in (("s1", ACCENTED), ("s2", OTHERS), ("s3", OTHERS[:0])):
        rows(data, DDL).write.parquet(f"{tmp_path}/{name}.parquet")
    q = registry.queries()
    got, plain = keys(q["normed_block_keys"](spark, str(tmp_path))), keys(q["block_keys"](spark, str(tmp_path)))
    assert {"W:plepulic", "W:voretan", "P:plepu", "A:gedeli"} <= got["S1a"] & got["S2a"]
    assert "W:plepulic" not in plain["S1a"]
    assert {"W:red", "W:stone", "W:foods"} <= got["S1b"] & got["S2b"]  # the alternative name
    assert any(k.startswith("W:") for k in got["S1c"] & got["S2c"]) and "S2c" not in plain
    want = {("S1a", "S2a"), ("S1b", "S2b"), ("S1c", "S2c")}
    assert {(r["s1"], r["o"]) for r in registry.flagship(spark, str(tmp_path)).collect()} == want
    assert ("S1c", "S2c") not in {(r["s1"], r["o"]) for r in q["owners"](spark, str(tmp_path)).collect()}


def test_pair_scores_are_read_from_one_table(spark):
    for name in ("pair_scores", "normed_pair_scores"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "pair-scores" in plan and "Exchange" not in plan


def test_feature_table_selects_candidates_once(spark):
    plan = registry.queries()["feature_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
