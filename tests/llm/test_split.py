import random
import re

from lodeseam.llm import split

EOL = r"(?:\r\n|[\n\r\x0b\x85\u2028\u2029])"


def level(t, limit):
    t = t.replace("\r\n", "\n")
    for name, sep in (("paragraph", rf"\f|{EOL}[ \t]*{EOL}"), ("line", rf"\f|{EOL}"), ("sentence", rf"\f|{EOL}|(?<=[.!?])\s"), ("word", r"\s+")):
        if max(len(x.strip()) for x in re.split(sep, t)) <= limit:
            return name
    return "forced"


def texts():
    rng = random.Random(1)
    glue = {"paragraph": ["\n\n", "\r\n \t\r\n", "\f"], "line": ["\n", "\r\n", "\r"], "sentence": [". ", "! ", "? "], "word": [" ", "\t", " "], "forced": ["", "-"]}
    for _ in range(120):
        kinds = rng.sample(list(glue), rng.randrange(1, 5))
        yield "".join("xy漢😀"[rng.randrange(4)] * rng.randrange(1, 40) + rng.choice(glue[rng.choice(kinds)]) for _ in range(rng.randrange(1, 40)))


def test_pieces_join_to_the_text_and_fit(spark):
    data = [*texts(), "", None, "z" * 5000, "a b " * 3000, " " * 700, "\f" * 300]
    df = spark.createDataFrame([(i, t, 5 if i % 2 else None, "p", 7) for i, t in enumerate(data)], "id int, content string, page int, piece string, piece_no int")
    rows = split.split_oversized(df, limit=200, overlap=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert by.keys() == set(range(len(data)))
    for i, t in enumerate(data):
        parts = sorted(by[i], key=lambda r: r["piece_no"])
        if t is None or len(t) <= 200:
            assert [(p["piece"], p["piece_cut"], p["piece_start"]) for p in parts] == [(t, None, 0)]
            continue
        assert {p["piece_cut"] for p in parts} == {level(t, 200)}
        whole = ""
        for p in parts:
            assert 0 < len(p["piece"]) <= 200 and t.startswith(p["piece"], p["piece_start"])
            assert p["piece_start"] == (max(0, len(whole) - 20) if whole else 0)
            assert p["piece_page"] == (5 + t.count("\f", 0, p["piece_start"]) if i % 2 else None)
            whole = whole[: p["piece_start"]] + p["piece"]
        assert whole == t


def test_natural_boundaries_win(spark):
    t = "one two three. four five six\nseven eight nine ten eleven twelve thirteen fourteen"
    got = split.split_oversized(spark.createDataFrame([(t,)], "content string"), page=None, limit=40, overlap=0).orderBy("piece_no").collect()
    assert [r["piece"] for r in got] == ["one two three. four five six\n", "seven eight nine ten eleven twelve ", "thirteen fourteen"]


def test_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab")], "id int, content string")
    assert split.split_oversized(df, page=None).count() == 2
    assert split.split_oversized(df.limit(0), page=None).count() == 0


def test_short_parts_before_long_ones_and_wide_blank_lines_are_boundaries(spark):
    a, b, c = "a" * 30, "b. " * 50 + "b", "c" * 30
    for blank in ("\n\n", "\n" + " " * 60 + "\n", "\r\n\t\r\n"):
        df = spark.createDataFrame([(blank.join((a, b, c)),)], "content string")
        got = [r["piece"].strip() for r in split.split_oversized(df, page=None, limit=160, overlap=0).orderBy("piece_no").collect()]
        assert got == [a, b, c]
    df = spark.createDataFrame([("x" * 150 + "\n" + "y" * 150,)], "content string")
    assert [(r["piece"], r["piece_cut"]) for r in split.split_oversized(df, page=None, limit=160, overlap=0).orderBy("piece_no").collect()] == [("x" * 150 + "\n", "line"), ("y" * 150, "line")]
