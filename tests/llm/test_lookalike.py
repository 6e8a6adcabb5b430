import unicodedata

from lodeseam.llm import lookalike as la

SAME = [("ＡＢＣ１", "ABC1"), ("é", "é"), ("ﬁne", "fine"), ("a b", "a b"), ("a　b", "a b"), ("a​b­", "ab"), ("раs", "pas"), ("Ο", "O"), ("е́", "é"), ("ﬃx", "ffix"), ("ệ", "ệ"), ("µ", "μ"), ("", "‍"), ("Å", "Å"), ("ｶﾞ", "ガ"), ("각", "각"), ("ѐ", "è"), ("Ⅳ", "IV"), ("ꓮꓐꓚ", "ABC"), ("ậ", "ậ"), ("e\u200b\u0301", "é"), ("ρоrt", "port"), ("x\x00y", "xy")]
DIFFERENT = [("A", "a"), ("é", "e"), ("²", "2"), ("①", "1"), ("½", "1/2"), ("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("™", "TM"), ("α", "a"), ("-", "–"), ("ß", "ss"), ("a b", "ab")]


def test_looks():
    for a, b in SAME:
        assert la.base_string(a) == la.base_string(b), (a, b)
    for a, b in DIFFERENT:
        assert la.base_string(a) != la.base_string(b), (a, b)


def test_every_member_of_a_class_becomes_one_form():
    of = la.tables()
    compare = la.comparer(of)
    for plain, members in of.variants.items():
        assert {compare(m) for m in members} == {compare(plain)} and compare(compare(plain)) == compare(plain)


def test_copies_are_not_joined_with_each_other(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id = 7, 'fооd', 'food') as text")
    assert la.look_alike_pairs(la.look_alike_classes(df)).count() == 4999


def test_union_find_is_transitive():
    uf = la.UnionFind()
    for a, b in (("x", "y"), ("z", "y"), ("p", "q")):
        uf.join(a, b)
    assert sorted(map(sorted, uf.classes())) == [["p", "q"], ["x", "y", "z"]]


def test_representatives_follow_frequency():
    often = la.rewriter({"é": 5, "é": 1})
    seldom = la.rewriter({"é": 1, "é": 5})
    assert often("caf" + unicodedata.normalize("NFD", "é")) == "café" and seldom("café") == "café"
    cyrillic = la.rewriter({"о": 9, "o": 1})
    assert cyrillic("fооd") == cyrillic("food") == "fооd"


def test_frame(spark):
    rows = [(1, "food"), (2, "fооd"), (3, "food"), (4, None), (5, ""), (6, "​"), (7, "Food"), (8, "ｆｏｏｄ"), (9, "x" * 500_000)]
    df = spark.createDataFrame([(i, t, "u") for i, t in rows], "doc_id bigint, text string, unified string")
    out = {r["doc_id"]: r["unified"] for r in la.unify_look_alikes(df).collect()}
    assert out == {1: "food", 2: "food", 3: "food", 4: None, 5: "", 6: "", 7: "Food", 8: "food", 9: "x" * 500_000}
    pairs = sorted(tuple(r) for r in la.look_alike_pairs(la.look_alike_classes(df)).collect())
    assert pairs == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (5, 6)]
    assert la.look_alike_pairs(la.look_alike_classes(df.limit(0))).count() == 0
