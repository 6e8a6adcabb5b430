import pytest

from lodeseam.llm import qa_defects as qa

MODEL = qa.WordModel([])
EN = "Which limit applies to the pump AB-12 at Harbour?"


@pytest.mark.parametrize(
    "question,answer,want",
    [
        (EN, None, "empty"), (EN, " ​\n", "empty"), (EN, "<p></p>", "empty"), (EN, "Answer:", "empty"), (EN, "[N/A]", "empty"), (EN, "...", "empty"), (EN, "12", None), (EN, "No", None),
        (EN, EN, "copy"), (EN, "Q: " + EN.lower(), "copy"), (EN, f"{EN} {EN}", "copy"), (EN, "limit applies to the pump AB-12 at Harbour", "copy"), (EN, f"You asked: {EN} The pump AB-12 has a limit of 9 bar.", None),
        (EN, "I'm sorry, but I can't help with that.", "refusal"), (EN, "Thank you for asking about AB-12; I must pass on this one. Please consult section 4.", "refusal"),
        (EN, "Operators are not able to open it by hand. The pump has a limit of 9 bar.", None), (EN, "Sorry for the late entry. The limit is 9 bar.", None),
        ("Wann wurde das Ventil geprüft?", "Dazu möchte ich mich nicht äußern.", "refusal"), ("Quand faut-il le vérifier ?", "Je ne suis pas en mesure de répondre.", "refusal"), ("¿Por qué hay que medir?", "Lo siento, no puedo ayudar con eso.", "refusal"),
        (EN, "Für die Pumpe gilt eine Grenze von 9 bar, weil das Ventil nicht geprüft wurde.", "language"), (EN, "The pump has a limit of 9 bar [«Tras el turno, el equipo de la»].", None), ("How is it named in the German edition?", "Die Pumpe", None),
        (EN, "The pump AB-12 has a limit of 9 bar. It is checked by the dut", "truncated"), (EN, "The limit is 9 bar, because of …", "truncated"), (EN, "The limit is 9 bar ... as the log says.", None), (EN, "The limit is (", "truncated"),
        (EN, "1. The limit is 9 bar.\n2.", "truncated"), (EN, "- one\n- two", None), (EN, "See case AB-12", None), (EN, "```\ncode", "truncated"), (EN, 'He said: "', "truncated"), (EN, "The limit (9 bar) holds.", None),
        (EN, "No can do.", "refusal"), (EN, "That is a question I'd rather leave unanswered.", "refusal"), (EN, "This goes beyond what I am willing to do.", "refusal"), (EN, "We cannot open the valve before the audit, says the log.", None),
        (EN, "Насос AB-12 имеет предел 9 бар.", "language"), (EN, "水泵的限值为九巴。", "language"), (EN, "Η αντλία έχει όριο εννέα.", "language"), (EN, "Pompa ma limit dziewięciu barów, ponieważ zawór nie był jeszcze sprawdzony.", "language"), (EN, "The unit is Ω, written Ωm.", None),
        ("How is it named in the Russian edition?", "Насос", None), (EN, "- open valve\n- close valve\n- then the", "truncated"), (EN, "- one.\n  - deep\n- two.", None), (EN, "- one.\n- two", "truncated"), (EN, 'Use <a href="x" and so on for ' + "long " * 40, "truncated"),
        (None, "An answer without a question.", None), ("", "An answer.", None), (None, None, "empty"),
    ],
)
def test_defects(question, answer, want):
    assert qa.defect_of(MODEL, question, answer) == want


def test_tiles_use_every_word_once():
    a, b = "x a b c y a b c".split(), "a b c z".split()
    assert qa.tile(a, b, 3) == [False, True, True, True, False, False, False, False]


def test_parser():
    assert qa.open_ends("a (b [c] «d») `e` \"f\" <b>g</b> 1) x") == []
    assert qa.open_ends("(a [b") == ["(", "["] and qa.open_ends("```\n(") == ["```"] and qa.open_ends("<b>x") == ["<b"]


def test_frame(spark):
    rows = [(1, EN, None, "x"), (1, EN, None, "x"), (2, EN, "The limit is 9 bar.", "x"), (3, None, "word " * 300_000, "x"), (None, EN, "", "x")]
    got = qa.find_defects(spark.createDataFrame(rows, "id bigint, question string, answer string, defect string")).collect()
    assert sorted((r["id"] or 0, r["defect"]) for r in got) == [(0, "empty"), (1, "empty"), (1, "empty"), (3, "truncated")]
    assert qa.find_defects(spark.createDataFrame([], "id bigint, question string, answer string")).count() == 0


def test_word_model_counts_all_rows(spark):
    from pyspark.sql import functions as F

    letters = F.translate((F.col("id") % 997).cast("string"), "0123456789", "abcdefghij")
    df = spark.range(21_000).select("id", F.concat(F.lit("which is the "), letters).alias("question"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("das ist der Wert von x"), letters)).otherwise(F.repeat(F.lit("it is the whole "), 600)).alias("answer"))
    got, want = qa.fit_words(df), qa.WordModel([t for r in df.collect() for t in r[1:]])
    assert got.odds == want.odds and got.languages == want.languages
