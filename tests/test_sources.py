"""Files of every kind that needs no library."""

import io
import zipfile

from pyspark.sql import functions as F

from lodeseam.sources import files


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return b.getvalue()


W = 'xmlns:w="urn:w"'


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("A plain text that is long enough \xff".encode("latin-1"))
    (tmp_path / "short.txt").write_text("short")
    (tmp_path / ".hidden.txt").write_text("hidden but long enough to be read")
    (tmp_path / "b.CSV").write_text("name,size\nbolt,\nnut,\nwasher with long name,4\n")
    (tmp_path / "c.html").write_text("<p>Visible text of a page</p><script>not this</script>")
    (tmp_path / "d.docx").write_bytes(zipped({"word/document.xml": f"<w:d {W}><w:p><w:t>First paragraph here</w:t></w:p><w:p><w:t>Second one</w:t></w:p></w:d>", "word/media/i.png": b"x"}))
    (tmp_path / "e.pptx").write_bytes(zipped({"ppt/slides/slide2.xml": f"<w:s {W}><w:p><w:t>Second slide of the show</w:t></w:p></w:s>", "ppt/slides/slide1.xml": f"<w:s {W}><w:p><w:t>First slide of the show</w:t></w:p></w:s>"}))
    (tmp_path / "f.xlsx").write_bytes(
        zipped({"xl/worksheets/sheet1.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>42.5</v></c></row></s>', "xl/sharedStrings.xml": "<s><si><t>name of item</t></si><si><t>weight in kg</t></si></s>"})
    )
    (tmp_path / "g.docx").write_bytes(b"not a zip")
    (tmp_path / "h.mp3").write_bytes(b"sound")
    got = {(r["source"].rsplit("/", 1)[-1], r["page"], r["doc_type"], r["text"]) for r in files.load_folder(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.txt", None, "text", "A plain text that is long enough �"),
        ("b.CSV", 3, "tabular", "name: washer with long name, size: 4"),
        ("c.html", None, "local_html", "Visible text of a page"),
        ("d.docx", None, "docx", "First paragraph here Second one"),
        ("d.docx", None, "docx_image", "Image from word/media/i.png"),
        ("e.pptx", 1, "pptx", "First slide of the show"),
        ("e.pptx", 2, "pptx", "Second slide of the show"),
        ("f.xlsx", 1, "tabular", "weight in kg: 42.5"),
    }
    heard = files.load_folder(spark, str(tmp_path), transcribe=lambda b: "what was said in the recording").where("doc_type = 'media_transcript'")
    assert [r["text"] for r in heard.collect()] == ["what was said in the recording"]
    assert files.list_files(spark, str(tmp_path), most=10).count() == 3


def test_markdown_and_rows(spark):
    df = spark.createDataFrame([([["a", " b "], [None, "2"]],)], "r array<array<string>>")
    assert df.select(files.markdown_table(F.col("r"))).first()[0] == "| a | b |\n| --- | --- |\n|  | 2 |"
    assert [r["row_text"] for r in files.render_rows(spark.createDataFrame([(1, None), (None, "y")], "a int, `b c` string")).collect()] == ["a: 1", "b c: y"]
