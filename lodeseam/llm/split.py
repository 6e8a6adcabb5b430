"""Splitting oversized texts at natural boundaries, with overlap.

One regular expression of bounded quantifiers does the cutting inside the JVM: its alternatives are ordered
by boundary strength, each consumes as much as fits, and single characters are the last resort. What a text is cut at is
read off the ends of its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2048, 100

#: The boundaries, strongest first; what is cut anywhere else is forced.
LEVELS = ("paragraph", "line", "sentence", "word", "forced")
_EOL = r"(?>\r\n|[\n\r\u000B\u0085\u2028\u2029])"
_BLANK = rf"(?:\f|{_EOL}[ \t]*{_EOL})"


def piece_pattern(core: int) -> str:
    """Pieces of at most ``core`` characters, with the white space that ends them as far as it fits."""
    some = f".{{1,{core}}}"
    end = r"(?:(?<=[\n\u000B\u0085\u2028\u2029])|(?<=\r)(?!\n))"
    # the line that ends here is blank: looked at only where a line ends
    blank = rf"{end}(?<=(?:\r(?!\n)|[\n\u000B\u0085\u2028\u2029])[ \t]{{0,{core}}}(?:\r\n|[\n\r\u000B\u0085\u2028\u2029]))"
    return "(?sU)" + "|".join((some + r"\z", some + rf"(?:(?<=\f)|{blank})", some + end, some + r"(?<=[.!?]\s)", some + r"(?<=\s)", some))


def bare_pattern(limit: int) -> str:
    """Pieces that have at most ``limit`` characters without the white space around them, each with that white space."""
    core = rf"\s*+(?=\S).{{1,{limit}}}(?<=\S)"
    return "(?sU)" + "|".join(
        (rf"(?=.)\s*+(?:(?=\S).{{1,{limit}}}(?<=\S))?\s*+\z", rf"{core}(?=\s*?{_BLANK})\s*+", rf"{core}(?=\s*?{_EOL})\s*+", rf"{core}(?<=[.!?])(?=\s)\s*+", rf"{core}(?=\s)\s*+", rf"\s*+(?=\S).{{1,{limit}}}")
    )


def end_level(piece: Column) -> Column:
    """Which of LEVELS (from 0) a piece of :func:`bare_pattern` ends at."""
    tail = F.regexp_extract(piece, r"(?sU)(\s*)\z", 1)
    return (
        F.when(tail.rlike(_BLANK), 0).when(tail.rlike(_EOL), 1).when(piece.rlike(r"(?U)[.!?]\s+\z"), 2).when(tail != "", 3).otherwise(4)
    )


def cut_level(text: Column, limit: int = LIMIT) -> Column:
    """The weakest boundary that the pieces of a text end at, the last piece aside: paragraph, line, sentence, word or forced.

    As every piece ends at the strongest boundary within reach, this is also the first level at which every
    part between boundaries fits.
    """
    pieces = F.regexp_extract_all(text, F.lit(bare_pattern(limit)), F.lit(0))
    ends = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), end_level)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.array_max(ends), F.lit(0)) + 1)


def split_oversized(df: DataFrame, text: str = "content", page: str | None = "page", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row: ``df`` plus ``piece_no, piece_start, piece, piece_page, piece_cut``.

    Lengths are code points. A text up to ``limit`` is one piece with a null ``piece_cut``; a null text gives
    one null piece, an empty one an empty piece. Longer texts are cut so that no piece, with the ``overlap``
    characters repeated from before its start, exceeds ``limit``; without the overlaps the pieces join to the
    text exactly. ``piece_cut`` is of the text (see :func:`cut_level`) and measures parts without white space and
    overlap, as ``limit`` is meant; a part longer than ``limit - overlap`` has to be cut once more, inside. ``piece_page`` is ``page`` plus the form feeds before
    ``piece_start``, null if page is null. Each text is run through once, whatever its length. Repeated rows are kept; the caller removes repeats.
    Columns of ``df`` named like the new ones are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    t = F.col(f"`{text}`")
    long = F.length(t) > limit
    pieces = F.when(long, F.regexp_extract_all(t, F.lit(piece_pattern(limit - overlap)), F.lit(0))).otherwise(F.array(t))
    new = ("piece_no", "piece_start", "piece", "piece_page", "piece_cut", "_pieces", "_page", "_folded")
    keep = [c for c in df.columns if c not in new]
    at = F.col(f"`{page}`").cast("int") if page else F.lit(None).cast("int")
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\f"), F.lit("")))
    # one pass over the pieces: where the next starts, the form feeds so far, and the overlap it repeats
    none = F.struct(
        F.lit(0).alias("end"), F.lit(0).alias("feeds"), F.lit("").alias("tail"), F.array().cast("array<struct<no:int,start:int,piece:string,feeds:int>>").alias("out")
    )

    def add(acc: Column, p: Column) -> Column:
        one = F.struct(
            F.size(acc["out"]).alias("no"),
            (acc["end"] - F.length(acc["tail"])).alias("start"),
            F.concat(acc["tail"], p).alias("piece"),
            (acc["feeds"] - feeds(acc["tail"])).alias("feeds"),
        )
        tail = F.right(F.concat(acc["tail"], F.coalesce(p, F.lit(""))), F.lit(overlap)) if overlap else F.lit("")
        return F.struct(
            (acc["end"] + F.coalesce(F.length(p), F.lit(0))).alias("end"), (acc["feeds"] + F.coalesce(feeds(p), F.lit(0))).alias("feeds"), tail.alias("tail"), F.array_append(acc["out"], one).alias("out")
        )

    cut = F.when(long, cut_level(t, limit)).alias("piece_cut")
    out = df.select(*[F.col(f"`{c}`") for c in keep], at.alias("_page"), F.aggregate(pieces, none, add)["out"].alias("_folded"), cut)
    out = out.select(*[F.col(f"`{c}`") for c in keep], "_page", "piece_cut", F.inline("_folded").alias("_no", "_start", "_piece", "_feeds"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_no").alias("piece_no"), F.col("_start").alias("piece_start"), F.col("_piece").alias("piece"), (F.col("_page") + F.col("_feeds")).alias("piece_page"), "piece_cut"
    )
