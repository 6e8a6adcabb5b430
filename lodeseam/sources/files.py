"""Loading files: one reader per kind, a router by extension, a guard by size.

Contents are read as binary in the executors. Formats that need a library degrade to no rows if it is
missing, as do files that cannot be read; .docx, .pptx and .xlsx need none.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.text import basename, clean_text, strip
from lodeseam.sources.html import visible_text

MAX_BYTES = 100 * 1024 * 1024
UNITS = "text string, source string, page int, doc_type string, media_type string, media_path string, structure_type string, needs_vlm_description boolean"
# The reader of each extension; all others are read as they are.
READERS = {
    "txt": "text", "md": "text", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "csv": "tabular", "xls": "tabular", "xlsx": "tabular", "html": "local_html", "htm": "local_html",
    "mp3": "media_transcript", "wav": "media_transcript", "m4a": "media_transcript", "mp4": "media_transcript", "mov": "media_transcript", "avi": "media_transcript",
}


IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")
#: Fixed value: stands for an image that could not be described.
NO_DESCRIPTION = "Image description unavailable."


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def route(path: Column) -> Column:
    """The reader of a path."""
    ext = extension(path)
    by = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])
    return F.coalesce(F.try_element_at(by, ext), F.lit("unstructured"))


def list_files(spark: SparkSession, folder: str, most: int = MAX_BYTES, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of the visible files up to ``most`` bytes; the guard acts before a file is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.where(F.col("length") <= most).where(~F.startswith(basename(F.col("path")), F.lit(".")))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def render_rows(df: DataFrame) -> DataFrame:
    """``page, text``-ready rendering of a table's rows: ``column: value, column: value`` without nulls."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in df.columns]
    return df.withColumn("row_text", F.concat_ws(", ", *parts))


def markdown_table(rows: Column) -> Column:
    """array(array(string)) to Markdown: a separator after the first row, null cells empty, cells trimmed."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


# --- readers of one file's bytes; each yields (text, page, doc_type, media_type, structure_type, needs description) ---


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def read_docx(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = []
        for p in _xml(z, "word/document.xml").iter():
            if _local(p.tag) == "p":
                lines.append("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t"))
        yield "\n".join(x for x in lines if x.strip()), None, "docx", "text", None, False
        for name in z.namelist():
            if name.startswith("word/media/"):
                yield f"Image from {name}", None, "docx_image", "image", "image", True


def read_pptx(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for no, name in slides:
            rels = f"ppt/slides/_rels/slide{no}.xml.rels"
            if rels in z.namelist():
                for r in _xml(z, rels):
                    if "media/" in r.get("Target", ""):
                        yield f"Image from slide {no}", no, "pptx_image", "image", "image", True
            texts = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in _xml(z, name).iter() if _local(p.tag) == "p"]
            yield "\n".join(x for x in texts if x.strip()), no, "pptx", "text", None, False


def _cells(z: zipfile.ZipFile) -> Iterator[list[str | None]]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _xml(z, "xl/sharedStrings.xml")]
    sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
    for row in _xml(z, sheet).iter():
        if _local(row.tag) != "row":
            continue
        out: list[str | None] = []
        for c in row:
            col = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                col = col * 26 + ord(ch) - 64
            out += [None] * (max(col, len(out) + 1) - 1 - len(out))
            text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
            out.append(shared[int(text)] if c.get("t") == "s" and text else text or None)
        yield out


def read_tabular(data: bytes, name: str) -> Iterator[tuple]:
    if name.lower().endswith(".csv"):
        import csv

        rows = [[x or None for x in r] for r in csv.reader(io.StringIO(data.decode("utf-8", errors="replace")))]
    elif name.lower().endswith(".xlsx"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows = list(_cells(z))
    else:  # .xls needs a library
        frame = pd.read_excel(io.BytesIO(data))
        rows = [list(frame.columns), *frame.astype(object).where(frame.notna(), None).to_numpy().tolist()]
    for i, r in enumerate(rows[1:]):
        yield ", ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False) if v is not None), i + 1, "tabular", "text", None, False


def read_pdf(data: bytes) -> Iterator[tuple]:
    try:
        import pymupdf
    except ImportError:
        return
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        for no, page in enumerate(doc, 1):
            yield page.get_text(), no, "pdf", "text", None, False
            for _ in page.get_images():
                yield f"Image from page {no}", no, "pdf_image", "image", "image", True


def _described(describe, data: bytes) -> str:
    try:
        return describe(data) or NO_DESCRIPTION
    except Exception:  # noqa: BLE001
        return NO_DESCRIPTION


def load_folder(spark: SparkSession, folder: str, transcribe=None, recognise=None, most: int = MAX_BYTES, only: DataFrame | None = None, describe=None, errors: bool = False) -> DataFrame:
    """All units of all files (or of the files whose ``path`` is in ``only``), in the columns of UNITS and ``error``.

    Texts are cleaned and empty ones dropped, images kept. ``transcribe`` and ``recognise`` (bytes to text)
    stand for speech and character recognition; without them such files give nothing. ``describe`` (bytes to text) stands
    for a model that describes images; where it fails, a fixed sentence stands. A file that cannot be read gives nothing
    or, with ``errors``, one row of nothing but its source and the ``error``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, data in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                try:
                    match kind:
                        case "docx":
                            units = list(read_docx(data))
                        case "pptx":
                            units = list(read_pptx(data))
                        case "tabular":
                            units = list(read_tabular(data, path))
                        case "pdf":
                            units = list(read_pdf(data)) or ([(recognise(data), None, "pdf_ocr", "text", None, False)] if recognise else [])
                        case "media_transcript":
                            units = [(transcribe(data), None, kind, "text", None, False)] if transcribe and len(data) <= 25 * 1024 * 1024 else []
                        case _ if path.lower().endswith(IMAGES):
                            units = [(_described(describe, data) if describe else path.rsplit("/", 1)[-1], None, kind, "image", None, describe is None)]
                        case _:
                            units = [(data.decode("utf-8", errors="replace"), None, kind, "text", None, False)]
                except Exception as e:  # noqa: BLE001
                    units = []
                    out.append(("", path, None, kind, None, None, None, False, f"{type(e).__name__}: {e}"))
                out += [(t, path, p, k, m, None, s, v, None) for t, p, k, m, s, v in units]
            yield pd.DataFrame(out, columns=["text", "source", "page", "doc_type", "media_type", "media_path", "structure_type", "needs_vlm_description", "error"])

    files = list_files(spark, folder, most)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")
    units = files.select("path", route(F.col("path")).alias("kind"), "content").mapInPandas(read, UNITS + ", error string")
    text = F.when(F.col("doc_type") == "local_html", visible_text(F.col("text"))).otherwise(F.col("text"))
    cleaned = F.when(F.col("media_type") == "image", F.col("text")).otherwise(clean_text(text))
    return units.withColumn("text", cleaned).where("text <> '' or error is not null" if errors else "text <> ''")
