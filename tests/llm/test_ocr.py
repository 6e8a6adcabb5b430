import random

from lodeseam.llm import ocr

WORDS = "the harbour engineer inspects every sealed pump before the autumn audit while the keeper writes the figures into the ledger".split()


def body(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_page_apart():
    p = ocr.Page("HEAD LINE   7\n\nA high-\ngrade pump was exam­\nined here.\n\nSecond part\nof it.\n- 7 -", 7, [0])
    n = {"highgrade": 0, "high-grade": 9, "examined": 5, "exam-ined": 0}
    assert p.head and p.number and p.join(n)
    assert p.text() == "A high-grade pump was examined here.\n\nSecond part of it."
    # a figure that is no page number stays
    q = ocr.Page("by the close of round\n305.", 7, [])
    assert not q.number and q.text() == "by the close of round 305."
    assert ocr.Page("Text.\n305.", None, []).number is False and ocr.Page("Text.\n— 305 —", None, []).number is True


def test_readings_undo_confusions():
    assert "pylon" in ocr.readings("pyl0n") and "isolates" in ocr.readings("isolatcs") and "channel" in ocr.readings("cliannel") and "claim" in ocr.readings("clairn")
    assert "channel" in ocr.twice("clianncl") and "possesses" in ocr.readings("p0$$e$$e$") and "x" * 40 + "o" * 40 in ocr.readings("x" * 40 + "0" * 40)
    assert len(ocr.readings("a" * 40 + "6" * 39)) < 1000
    assert ocr.like("pump", "PUMP") == "PUMP" and ocr.like("pump", "Pump") == "Pump" and ocr.like("pump", "pump") == "pump"


def test_the_channel_tells_printed_figures_from_misread_ones(spark):
    # "pumps2b" is met often enough to be printed so; "va1ve" is a misread word, "zelilh0lm" a name never met otherwise
    rows = [(i, "s", 1, "pdf_ocr", "the valve of pumps2b is sealed. " * 120) for i in range(3)] + [(7, "s", 1, "pdf_ocr", "the va1ve is sealed."), (8, "s", 1, "pdf_ocr", "the valve at zelilh0lm is sealed.")]
    got = {r["id"]: (r["kinds"], r["text"]) for r in ocr.repair_pages(spark.createDataFrame(rows, "id bigint, source string, page int, kinds string, content string")).collect()}
    assert got[0][0] == [] and got[7] == (["chars"], "the valve is sealed.") and got[8] == (["chars"], "the valve at zelilholm is sealed.")


def test_two_readings_of_a_head_share_a_key():
    a, b, c = (set(ocr.head_keys(x)) for x in ("Spare ballast valve   12", "SPARE BALLXST VALVE | 13", "14  Spare ballast va1ve"))
    assert a & b and b & c and not ocr.head_keys("Page 12") and not ocr.head_keys("12")


def test_pages(spark):
    rng = random.Random(1)
    clean = [(i, "s", i, "text", body(rng)) for i in range(80)]
    pages = []
    for k in range(6):
        t = body(rng, 40)
        pages.append((100 + k, "scan.pdf", k + 1, "pdf_ocr", f"Spare ballast va{'x' if k == 2 else 'l'}ve | {k + 1}\n{t}"))
    pages += [(110, "scan.pdf", 7, "pdf_ocr", "the harb0ur engin­\neer inspccts every pump.\n\n7"), (111, "other.pdf", 1, "pdf_ocr", "Spare ballast valve\nthe pump."), (112, None, None, "pdf_ocr", ""), (113, "x", 1, "pdf_ocr", None), (110, "scan.pdf", 7, "pdf_ocr", "the harb0ur engin­\neer inspccts every pump.\n\n7"), (114, "y", 3, "pdf_ocr", "AB-120 the sealed pump 0f 12 kg in the 3rd ledger " * 2000)]
    cols = "id bigint, source string, page int, kinds string, content string"
    rows, corpus = spark.createDataFrame(pages, cols), spark.createDataFrame(clean + pages, cols)
    got = {r["id"]: (r["kinds"], r["text"]) for r in ocr.repair_pages(rows, corpus).collect()}
    assert got.keys() == {*range(100, 106), 110, 111, 112, 114}
    assert all(got[100 + k][0] == ["header", "pageno"] for k in range(6)) and "ballast" not in got[102][1]
    assert got[110] == (["chars", "hyphen", "pageno"], "the harbour engineer inspects every pump.")
    assert got[111] == ([], "Spare ballast valve the pump.") and got[112] == ([], "")
    assert got[114][0] == []
    assert ocr.repair_pages(rows.limit(0)).count() == 0
