"""One form for texts that look the same.

Strings that look alike are joined by union-find over strings and code points, so that a full-width Cyrillic-
shaped letter, its ordinary form and the Latin letter end in one class; a longer string is joined with what it
becomes letter by letter. An automaton over all members of all classes rewrites the texts greedily, to the plainest
member while texts are compared, and to the one most frequent in the corpus when they come out.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage

# Letters of other alphabets and the Latin letters of the same shape.
SAME_SHAPE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϲ": "C", "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ρ": "p",
    # Armenian, the micro sign, which is the Greek letter, and the Latin letter of phonetic script
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "µ": "μ", "ɡ": "g",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮲ": "P", "Ꮯ": "C", "Ꮮ": "L", "Ꮶ": "K",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Code points outside category Cf that show nothing.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏"
#: The decompositions taken to look like what they decompose to; joined letters are <compat> ones of letters only.
PLAIN_TAGS = ("<wide>", "<narrow>")
#: ASCII that shows nothing.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")


class UnionFind:
    """Classes of strings; the root of a class is arbitrary, the members are what counts."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.up:
            by.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in by.values() if len(v) > 1]


def _unseen(c: str) -> bool:
    # prepended marks (Arabic number signs and the like) are category Cf, but show
    cp = ord(c)
    variation = 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF
    shown = 0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= cp <= 0xFFFB or 0x13430 <= cp <= 0x1343F
    control = unicodedata.category(c) == "Cc" and c not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"
    return variation or control or c in UNSEEN or (unicodedata.category(c) == "Cf" and not shown)


@cache
def look_alikes() -> UnionFind:
    """The classes of whole strings, from rules over all of Unicode and SAME_SHAPE."""
    uf = UnionFind()
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or (cp < 0x80 and cp >= 0x20 and cp != 0x7F):
            continue
        if _unseen(c):
            uf.join(c, "")
            continue
        if unicodedata.category(c) == "Zs":
            uf.join(c, " ")
            continue
        if 0xAC00 <= cp <= 0xD7A3:  # composed by rule; see canonical()
            continue
        parts = unicodedata.decomposition(c).split()
        if not parts:
            continue
        if parts[0] in PLAIN_TAGS:
            uf.join(c, "".join(chr(int(x, 16)) for x in parts[1:]))
        elif parts[0][0] != "<":
            uf.join(c, unicodedata.normalize("NFD", c))
        elif parts[0] == "<compat>":
            to = [chr(int(x, 16)) for x in parts[1:]]
            # joined letters, and the letters that Roman numerals are
            roman = unicodedata.category(c) == "Nl"
            if all(unicodedata.category(x)[0] == "L" for x in to) and (roman or (len(to) > 1 and unicodedata.category(c)[0] == "L")):
                uf.join(c, "".join(to))
    for a, b in SAME_SHAPE.items():
        uf.join(a, b)
    # a string looks like what its letters look like, accents put together
    more = True
    while more:
        more, best = False, {m: plainest(v) for v in uf.classes() for m in v}
        for m in [m for m in uf.up if len(m) > 1]:
            to = unicodedata.normalize("NFC", "".join(best.get(c, c) for c in unicodedata.normalize("NFD", m)))
            if uf.find(to) != uf.find(m):
                uf.join(m, to)
                more = True
    return uf


def plainest(members: list[str]) -> str:
    """The member that all are compared by: accents composed, plain ASCII over other letters, letters apart over joined ones."""
    return "" if "" in members else min((unicodedata.normalize("NFC", m) for m in members), key=lambda m: (sum(ord(x) > 127 for x in m), -len(m), [ord(x) for x in m]))


class Tables(NamedTuple):
    """What the workers need: the plainest member for each other member, and all members of each class by its plainest."""

    plain: dict[str, str]
    variants: dict[str, list[str]]


@cache
def tables() -> Tables:
    """Built once on the driver from all of Unicode, and shipped with the tasks; their size is bounded by it."""
    plain: dict[str, str] = {}
    variants: dict[str, list[str]] = {}
    for members in look_alikes().classes():
        best = plainest(members)
        plain |= {m: best for m in members if m != best}
        if best:
            variants[best] = sorted({*members, best})
    return Tables(plain, variants)


def automaton(forms: dict[str, str]) -> Callable[[str], str]:
    """A function that rewrites every key of ``forms`` in a text, leftmost and longest first."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for a, b in forms.items():
        auto.add_word(a, (len(a), b))
    if not forms:
        return lambda text: text
    auto.make_automaton()

    def rewrite(text: str) -> str:
        out, at = [], 0
        for end, (n, to) in auto.iter_long(text):
            out += [text[at : end + 1 - n], to]
            at = end + 1
        return "".join([*out, text[at:]]) if out else text

    return rewrite


def comparer(of: Tables) -> Callable[[str], str]:
    """A function whose results are equal for two texts exactly if they look the same.

    Characters that go, or change, can bring others together: composing and rewriting are repeated until nothing changes.
    """
    rewrite = automaton(of.plain)
    # every member has one of these, so a text without them, accents composed, is in its one form
    telling = {c for m in of.plain for c in m if ord(c) > 127} | {m for m in of.plain if len(m) == 1}

    def compare(text: str) -> str:
        if text.isascii() and not _CONTROL.search(text):
            return text
        while True:
            text = unicodedata.normalize("NFC", text)
            if telling.isdisjoint(text):
                return text
            text, before = rewrite(text), text
            if text == before:
                return text

    return compare


def base_string(text: str) -> str:
    """Equal for two texts exactly if they look the same."""
    return comparer(tables())(text)


def count_forms(docs: DataFrame, text: str) -> DataFrame:
    """``form, n``: how often each code point, and each longer spelling of a class, occurs in all texts.

    Counted per batch and summed before and after one shuffle; there are at most as many forms as code points
    and spellings in Unicode, so the result is bounded whatever the corpus.
    """

    longer = [m for v in tables().variants.values() for m in v if len(m) > 1]

    def count(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for m in longer:
            auto.add_word(m, m)
        auto.make_automaton()
        for pdf in batches:
            n: Counter = Counter()
            for t in pdf["t"]:
                if t:
                    n.update(t)
                    n.update(m for _, m in auto.iter(t))
            yield pd.DataFrame({"form": list(n.keys()), "n": list(n.values())}, columns=["form", "n"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


def representatives(counts: dict[str, int], variants: dict[str, list[str]]) -> dict[str, str]:
    """Plainest member of each class to its most frequent one; ties prefer the plainest, the composed, then the smaller form."""
    return {b: max(v, key=lambda m: (counts.get(m, 0), m == b, -len(m), [-ord(x) for x in m])) for b, v in variants.items()}


def rewriter(counts: dict[str, int], of: Tables | None = None) -> Callable[[str], str]:
    """A function that rewrites a text to its one form, in the most frequent members."""
    of = of or tables()
    frequent = {b: r for b, r in representatives(counts, of.variants).items() if b != r}
    compare, rewrite = comparer(of), automaton(frequent)
    return lambda text: rewrite(compare(text))


def unify_look_alikes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``unified``: one string for all texts that look the same, others for others.

    Alike: full- and half-width and ordinary forms, composed and decomposed accents, joined letters and the
    letters, any space character and the plain space, characters that show nothing and none, and letters of
    the same shape of Latin, Cyrillic, Greek and Armenian, all transitively. Case, accents, raised, circled
    and fraction forms stay apart, as do tabs and line ends. Null stays null; an empty text, and one of
    unseen characters only, becomes empty. Letters of Coptic, Cherokee and Lisu and Roman numerals count, too. The counts that choose representatives cover all texts; they are
    bounded by Unicode and go to the workers with the task. A column named ``unified`` is replaced.
    """
    counts = {r["form"]: r["n"] for r in count_forms(docs, text).collect()}
    of = tables()
    known = {m for v in of.variants.values() for m in v}
    counts = {k: v for k, v in counts.items() if k in known}

    @F.pandas_udf("string")
    def unify(s: pd.Series) -> pd.Series:
        rewrite = rewriter(counts, of)
        return pd.Series([None if t is None else rewrite(t) for t in s], dtype="object")

    return docs.withColumn("unified", unify(F.col(f"`{text}`")))


def look_alike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, variant``: documents whose texts look the same share ``class_id``; ``variant`` tells the strings apart.

    One row per document with a text; both are 128-bit digests, so no text is shuffled.
    """
    u = unify_look_alikes(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t")).where("_t is not null"), "_t")
    return u.select(key, F.substring(F.sha2("unified", 256), 1, 32).alias("class_id"), F.substring(F.sha2("_t", 256), 1, 32).alias("variant"))


def look_alike_pairs(classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``a, b`` with a < b: documents whose texts are different strings but look the same.

    Classes of one string only never reach the joins; copies of one string are never joined with each other.
    """
    classes = cut_lineage(classes)  # read several times
    strings = classes.groupBy("class_id", "variant").agg(F.count("*").alias("n"))
    several = strings.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    strings = cut_lineage(strings.join(several, "class_id", "left_semi").select("class_id", "variant"))
    # different strings first, each pair once; copies of a string are put in last, as rows of the result
    pairs = strings.withColumnRenamed("variant", "va").join(strings.withColumnRenamed("variant", "vb"), "class_id").where("va < vb")
    held = classes.join(strings, ["class_id", "variant"], "left_semi")
    one = lambda v, k: held.select("class_id", F.col("variant").alias(v), F.col(key).alias(k))
    out = pairs.join(one("va", "x"), ["class_id", "va"]).join(one("vb", "y"), ["class_id", "vb"])
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
