from pyspark.sql import functions as F

from kinloom.functions import text as t

NAMES = [
    ("A.B.C. Pvt. Ltd.", "abc pvt ltd", "abc", "", "ltd pvt", 0),
    ("Blue Sky LLC formerly known as Red Sea Inc", "blue sky llc", "blue sky", "red sea", "llc", 0),
    ("my-shop.com", "my shop", "my shop", "", "", 1),
    ("5tar P1umbing l l c", "star plumbing llc", "star plumbing", "", "llc", 0),
    ("Mr. Smith & Sons Privte Limted ref no: 5567", "mr smith and sons pvt ltd", "smith sons", "", "ltd pvt", 0),
    ("The Company", "the company", "", "", "co", 0),
    ("Société Générale S.A.S.", "societe generale sas", "societe generale", "", "sas", 0),
    (None, "", "", "", "", 0),
    ("", "", "", "", "", 0),
]


def test_names(rows):
    df = rows([(n, n) for n, *_ in NAMES], "name string, n_full string").drop("n_full")
    got = [tuple(r) for r in t.norm_name(df, "name").select("n_full", "n_core", "n_alt", "n_legal", "n_dom").collect()]
    assert got == [x[1:] for x in NAMES]


def test_addresses(rows):
    data = [
        ("No. 12-14, 152nd St, Apt 5, Ohio 43001", "US", "12 152 st oh 43001", "12 152 43001", ""),
        ("12 Elm Terrace, Dallas, Texas", "US", "12 elm dallas tx", "12", "tx"),
        ("H.No. 007, Main Road, Mumbai, Maharashtra", "India", "007 main rd mumbai mh", "7", "mh"),
        ("#5, MG Rd, महाराष्ट्र", "India", None, "5", None),
        ("8400-8404 Elm Street", "US", "8400 elm st", "8400", ""),
        ("8400-9404 Elm Street", "US", "8400 9404 elm st", "8400 9404", ""),
        ("", "US", "", "", ""),
        (None, "US", "", "", ""),
    ]
    df = rows([(a, c) for a, c, *_ in data], "address string, country string")
    got = [tuple(r) for r in t.norm_addr(df, "address").select("a_norm", "a_nums", "a_state").collect()]
    for (_, _, norm, nums, state), (g_norm, g_nums, g_state) in zip(data, got, strict=True):
        assert g_nums == nums
        assert norm is None or (g_norm, g_state) == (norm, state)


def test_romanise_keeps_ascii_in_the_jvm(rows):
    df = rows([("Ａｂｃ  Déjà",), ("plain  Text",), ("वोवजि तेदतु",), (None,)], "x string")
    assert [r[0] for r in df.select(t.romanise(F.col("x"))).collect()] == ["abc deja", "plain text", "vovaji tedatu", ""]


def test_steps_of_normalisers_are_planned_once(rows):
    # a step that is planned again for every place that reads it is worked out there again
    df = rows([("Vano Ltd", "12 Rue Gedeli, Tulsa", "US")], "name string, address string, country string")
    plan = t.norm_record(df, "name", "address")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") == len(t.lx.LEGAL_LONG)
    assert plan.count(t.lx.UNITS[0]) == 1
