"""Repairing text from scanned pages: running heads, page numbers, divided and misread words.

Misread words are corrected by a noisy channel: the probability of a confusion of characters, estimated from
the corpus itself, times the likelihood of the words by corpus unigrams and bigrams, decoded per line by
Viterbi over each word's candidates. Corpus counts never leave the executors, but for the words that make up
a fixed share of the corpus, of which there are few.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage, hot_keys, salted_lookup

# What a scanner reads, and what may have been printed.
CONFUSIONS = {
    "0": ("o",), "1": ("l", "i"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("b", "é", "g"), "7": ("t",), "8": ("b",), "9": ("g",), "+": ("t",), "|": ("l", "i"), "!": ("l", "i"), "$": ("s",), "@": ("a",), "€": ("e",),
    "c": ("e",), "e": ("c",), "m": ("rn",), "h": ("b",), "ii": ("u", "ü"), "li": ("h",), "cl": ("d",), "rn": ("m",), "vv": ("w",), "ri": ("n",), "nn": ("m",), "in": ("m",), "fi": ("h",), "lc": ("k",), "tl": ("d",),
}
#: Words that make up at least this share of all are common: at most its reciprocal many, never misreadings.
COMMON_SHARE = 1e-4
#: A word is held a misreading of another that the corpus has at least so many times as often, and so often at all;
#: fewer times do for a confusion that explains at least USUAL of all misread words.
RATIO, LEAST = 20.0, 5
USUAL, USUAL_RATIO, USUAL_LEAST = 0.02, 4.0, 3
#: A word that two confusions explain must be met so seldom, and its candidate so much more often for each.
TWICE_MOST = 2
#: Ways to read a word's figures that are tried place by place.
EACH_PLACE = 4096
#: How much less likely a printed word has figures or signs among its letters than not, and the count of a word never met.
PRINTED, UNMET = 1e-3, 0.5
#: Occurrences by which a word's pairs are damped.
PAIR_PRIOR = 50
#: A running head stands on at least so many pages of its source.
HEAD_PAGES = 3
#: Lines at the top and the foot of a page that may be running heads or page numbers.
MARGIN = 2

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_EOL = re.compile(r"\r\n|[\n\r\f\v\x85\u2028\u2029]")
_HYPHEN = "-­‐¬‑"
_BREAK = re.compile(rf"([^\W\d_]+)([{_HYPHEN}])[ \t ]*$")
_NEXT = re.compile(r"[ \t ]*([^\W\d_]+)")
_CODE = re.compile(r"[A-Z]{1,5}-?\d[\d.,/-]*[A-Za-z]?")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|re|ère|e|è?me|o|a|º|ª|[a-zA-Zµ]{1,3}|[²³])")
_ALIEN = re.compile(r"[\d+|!$@€]")
#: A word of the body: letters, and what may be a letter misread.
_TOKEN = re.compile(r"[^\W_][^\W_'’]*(?:[+|!$@€][^\W_'’]*)*|[+|!$@€](?=[^\W\d_])[^\W_'’]+(?:[+|!$@€][^\W_'’]*)*")
_PAGE_WORD = r"(?:page|pages|p|pg|pag|pág|página|seite|s|blatt|folio|f|no|nr)"


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def bigram_hash(a: int, b: int) -> int:
    return int(((a * 0x9E3779B97F4A7C15 ^ (b + 0x632BE59BD9B4E019)) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def count_corpus(rows: DataFrame, text: str) -> DataFrame:
    """``h, n``: hashes of all words, words with figures or signs inside, hyphenated compounds and pairs of neighbouring words in all texts, and their counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[str, int] = {}
        words: Counter = Counter()
        for pdf in batches:
            pairs = []
            for t in pdf["t"]:
                if not t:
                    continue
                low = t.lower()
                found = _WORD.findall(low)
                words.update(found)
                if _ALIEN.search(low):
                    words.update(w for w in _TOKEN.findall(low) if _ALIEN.search(w) and not w.isdecimal())
                if "-" in low:
                    words.update(_COMPOUND.findall(low))
                for w in found:
                    if w not in ids:
                        ids[w] = hash_of(w)
                pairs.append(np.array([ids[w] for w in found], dtype=np.int64).view(np.uint64))
            if pairs:
                a = np.concatenate([p[:-1] for p in pairs])
                b = np.concatenate([p[1:] for p in pairs])
                mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xC2B2AE3D27D4EB4F)
                h, n = np.unique((mixed ^ np.uint64(1 << 63)).view(np.int64), return_counts=True)
                yield pd.DataFrame({"h": h, "n": n})
            if len(words) > 300_000:
                yield pd.DataFrame({"h": [hash_of(w) for w in words], "n": list(words.values())})
                words.clear()
            if len(ids) > 500_000:
                ids.clear()
        yield pd.DataFrame({"h": [hash_of(w) for w in words], "n": list(words.values())}).astype("int64")

    counted = rows.select(F.col(f"`{text}`").alias("t")).where("t is not null").mapInPandas(count, "h bigint, n bigint")
    return counted.groupBy("h").agg(F.sum("n").alias("n"))


# --- the margins of a page -------------------------------------------------------------------------------------


def margin_lines(lines: list[str]) -> list[int]:
    """Positions of the first and last lines that are not blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*full[:MARGIN], *full[-MARGIN:]})


def strip_number(line: str) -> tuple[str, str | None]:
    """A line without the number at its start or end, and that number."""
    t = line.strip()
    if m := re.match(r"(\d{1,6})(?:\s{2,}|\s*[|–—-]\s+|\s+(?=\D))(\S.*)$", t):
        return m[2].strip(" |"), m[1]
    if m := re.match(r"(.*\S)(?:\s{2,}|\s*[|]\s*|\s+[–—-]\s+|\s+)(\d{1,6})$", t):
        return m[1].strip(" |"), m[2]
    return t, None


def page_number(line: str) -> str | None:
    """The number of a line that holds nothing but a page number, decorated or not."""
    t = line.strip()
    m = re.fullmatch(rf"[\W_]*(?:{_PAGE_WORD}\b)?[\W_]*(\d{{1,6}})(?:\s*(?:/|of|de|von|sur|out of)\s*\d{{1,6}})?[\W_]*", t, re.IGNORECASE)
    return m[1] if m else None


def head_keys(line: str) -> list[str]:
    """Keys that two readings of one running head share although each may have a character misread, or two.

    The line without its number, in small letters, is cut into four stretches; a key is its length and two of
    the stretches, so readings that differ in at most two places agree on one. Of fewer than six letters, two places
    tell nothing: such a line has only itself as a key.
    """
    t = strip_number(line)[0].lower()
    letters = sum(c.isalpha() for c in t)
    if letters < 2 or page_number(line) is not None:
        return []
    n = len(t)
    if letters < 6:
        return [f"{n}|{t}"]
    cut = [t[n * i // 4 : n * (i + 1) // 4] for i in range(4)]
    return [f"{n}|{i}{j}|{cut[i]}|{cut[j]}" for i, j in combinations(range(4), 2)]


def find_heads(pages: DataFrame) -> DataFrame:
    """``id, heads``: the positions of the lines of each page that are running heads or feet of its source."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s, p, t in zip(pdf["id"], pdf["source"], pdf["page"], pdf["content"], strict=True):
                lines = _EOL.split(t)
                for at in margin_lines(lines):
                    # pages without a number count by themselves
                    out += [(i, hash_of(f"{s}\0{k}"), at, i if pd.isna(p) else -1 - int(p)) for k in head_keys(lines[at])]
            yield pd.DataFrame(out, columns=["id", "k", "at", "sheet"])

    found = cut_lineage(pages.select("id", "source", "page", "content").mapInPandas(keys, "id bigint, k bigint, at int, sheet bigint"))
    often = found.select("k", "sheet").distinct().groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= HEAD_PAGES).select("k")
    kept = salted_lookup(found, often, "k", "id", hot_keys(found, "k"), "inner")
    return kept.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("heads"))


class Page:
    """A page taken apart: running heads and page numbers aside, the lines of its body with divided words joined."""

    def __init__(self, text: str, page: int | None, heads: list[int]) -> None:
        lines = _EOL.split(text)
        margins = margin_lines(lines)
        self.head, self.number = False, False
        drop = set()
        for i in margins:
            alone = page_number(lines[i])
            rest, no = strip_number(lines[i])
            if i in heads:
                self.head = True
                drop.add(i)
                self.number |= no is not None and (page is None or int(no) == page)
            elif alone is not None and (int(alone) == page if page is not None else re.fullmatch(r"\d+\.?", lines[i].strip()) is None):
                # without a known page number only a decorated number counts
                self.number = True
                drop.add(i)
            elif no is not None and page is not None and int(no) == page and re.search(r"^\s*\d+\s{2,}|(?:\s{2,}|\|\s*)\d+\s*$", lines[i]):
                self.number = True
                drop.add(i)
        self.lines = [x.rstrip() for i, x in enumerate(lines) if i not in drop]
        #: (line, first half, mark, second half) of words divided at a line end
        self.breaks = []
        for i, x in enumerate(self.lines[:-1]):
            m, n = _BREAK.search(x), _NEXT.match(self.lines[i + 1])
            if m and n and n[1][0].islower():
                self.breaks.append((i, m[1], m[2], n[1]))

    def asks(self) -> list[str]:
        """What the corpus must be asked about the divided words: joined, and with the hyphen, with what stands before."""
        out = []
        for i, a, _, b in self.breaks:
            out += [(a + b).lower(), self._compound(i, a, b)[0], a.lower(), b.lower()]
        return out

    def _compound(self, i: int, a: str, b: str) -> tuple[str, int]:
        # the other parts of a compound, on either side
        left = re.search(rf"((?:[^\W\d_]+-)*){re.escape(a)}[{_HYPHEN}][ \t ]*$", self.lines[i])
        right = re.match(rf"[ \t ]*{re.escape(b)}((?:-[^\W\d_]+)*)", self.lines[i + 1])
        return f"{left[1] if left else ''}{a}-{b}{right[1] if right else ''}".lower(), 0

    def join(self, n: dict[str, int]) -> bool:
        """Join divided words by the counts of :meth:`asks`; is any of them written without a hyphen?"""
        divided = False
        for i, a, mark, b in self.breaks:
            whole, compound = n.get((a + b).lower(), 0), n.get(self._compound(i, a, b)[0], 0)
            if mark in "­¬" and not compound:
                plain = True
            elif whole or compound:
                plain = whole >= compound
            else:
                # neither is known: two words of their own make a compound, two fragments a word
                plain = not (n.get(a.lower(), 0) >= LEAST and n.get(b.lower(), 0) >= LEAST)
            divided |= plain
            keep = "" if plain else "-"
            end = _BREAK.search(self.lines[i])
            start = _NEXT.match(self.lines[i + 1])
            # the rest of the word moves up, with what directly follows it
            tail = re.match(r"\S*", self.lines[i + 1][start.start(1) :])[0]
            self.lines[i] = self.lines[i][: end.start()] + a + keep + tail
            self.lines[i + 1] = self.lines[i + 1][start.start(1) + len(tail) :].lstrip()
        return divided

    def words(self) -> list[list[tuple[int, int, str]]]:
        """Per line the words that a misreading could be in: (start, end, word); codes and figures are none."""
        out = []
        for x in self.lines:
            skip = [m.span() for m in _CODE.finditer(x)]
            row = []
            for m in _TOKEN.finditer(x):
                w = m[0].rstrip("|!$@€") if not m[0][-1].isalpha() and not m[0].endswith("+") else m[0]
                if not any(c.isalpha() for c in w) or _ORDINAL.fullmatch(w) or any(a <= m.start() < b for a, b in skip):
                    continue
                row.append((m.start(), m.start() + len(w), w))
            out.append(row)
        return out

    def text(self) -> str:
        """Paragraphs of one line each, parted by blank lines."""
        parts, now = [], []
        for x in [*self.lines, ""]:
            if x.strip():
                now.append(x.strip())
            elif now:
                parts.append(re.sub(r"[ \t ]+", " ", " ".join(now)))
                now = []
        return "\n\n".join(parts)


# --- misread words ---------------------------------------------------------------------------------------------


def readings(word: str) -> dict[str, str]:
    """What may have been printed where ``word`` is read: candidate to the confusion, ``read>printed``.

    Figures and signs within a word are all replaced; otherwise one confusion is undone, or the same one
    wherever it occurs.
    """
    w = word.lower()
    out: dict[str, str] = {}
    alien = [i for i, c in enumerate(w) if _ALIEN.match(c)]
    if not alien:
        return _single(w)
    options = [CONFUSIONS.get(w[i], ()) for i in alien]
    if math.prod(map(len, options)) <= EACH_PLACE:
        for to in product(*options):
            s = list(w)
            for i, c in zip(alien, to, strict=True):
                s[i] = c
            out.setdefault("".join(s), f"{w[alien[0]]}>{to[0]}")
    else:  # so many figures: the same one is the same letter wherever it occurs
        kinds = sorted({w[i] for i in alien})
        for to in product(*(CONFUSIONS.get(c, ()) for c in kinds)):
            out.setdefault("".join(dict(zip(kinds, to, strict=True)).get(c, c) for c in w), f"{kinds[0]}>{to[0]}")
    for c in list(out):
        for d, how in _single(c).items():
            out.setdefault(d, how + "*")
    return out


def twice(word: str) -> dict[str, str]:
    """What may have been printed where two different confusions of letters happened: candidate to ``first+second``."""
    out: dict[str, str] = {}
    once = _single(word.lower())
    for c, how in once.items():
        for d, more in _single(c).items():
            if d != word and d not in once:
                out.setdefault(d, f"{how}+{more}")
    return out


def _single(w: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for size in (1, 2):
        for i in range(len(w) - size + 1):
            for to in CONFUSIONS.get(w[i : i + size], ()):
                out.setdefault(w[:i] + to + w[i + size :], f"{w[i : i + size]}>{to}")
                if w.count(w[i : i + size]) > 1:
                    out.setdefault(w.replace(w[i : i + size], to), f"{w[i : i + size]}>{to}")
    out.pop(w, None)
    return out


def like(cand: str, word: str) -> str:
    """``cand`` in the case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return cand.upper()
    return cand[:1].upper() + cand[1:] if word[:1].isupper() or (not word[:1].isalpha() and len(letters) > 1 and letters[0].isupper()) else cand


def corrections(types: DataFrame, counts: DataFrame) -> DataFrame:
    """``w, cands``: the words of ``types`` (``w``) taken for misreadings, with array(struct(c, n, p)).

    p is the probability of the confusion, estimated from how many words of the corpus it explains. A word of
    letters only must be far rarer than its candidate; one with figures or signs inside is always one.
    """

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, hash_of(w), c, hash_of(c), how) for w in pdf["w"] for c, how in readings(w).items()]
            yield pd.DataFrame(out, columns=["w", "wh", "c", "ch", "how"])

    def undo_twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, nw, c, hash_of(c), how) for w, nw in zip(pdf["w"], pdf["nw"], strict=True) for c, how in twice(w).items()]
            yield pd.DataFrame(out, columns=["w", "nw", "c", "ch", "how"])

    tried = types.mapInPandas(undo, "w string, wh bigint, c string, ch bigint, how string")
    known = tried.join(counts.select(F.col("h").alias("ch"), F.col("n").alias("nc")), "ch")
    known = known.join(counts.select(F.col("h").alias("wh"), F.col("n").alias("nw")), "wh", "left")
    alien = F.col("w").rlike(r"[\d+|!$@€]")
    known = known.select("w", "c", "nc", F.coalesce("nw", F.lit(1)).alias("nw"), "how", alien.alias("alien"))
    far = lambda least, ratio: F.col("nc") >= F.greatest(F.lit(float(least)), ratio * F.col("nw"))
    fits = cut_lineage(known.where(F.col("alien") | far(USUAL_LEAST, USUAL_RATIO)).withColumn("sure", F.col("alien") | far(LEAST, RATIO)))
    # one confusion per kind: bounded by the table of confusions
    kinds = {r["how"]: r["n"] for r in fits.where("sure").groupBy("how").agg(F.count_distinct("w").alias("n")).collect()}
    total = sum(kinds.values()) or 1
    prob = {k: (v + 0.1) / (total + 0.1 * len(kinds)) for k, v in kinds.items()}
    if not prob:
        return fits.select("w", F.array(F.struct("c", "nc", F.lit(0.0).alias("p"))).alias("cands")).limit(0)
    p = F.try_element_at(F.create_map(*[x for k, v in prob.items() for x in (F.lit(k), F.lit(v))]), F.col("how"))
    # a confusion that explains next to nothing is chance, unless a figure proves the word misread
    scored = fits.withColumn("p", F.coalesce(p, F.lit(0.001))).where(F.col("alien") | (F.col("sure") & (F.col("p") > 0.0005)) | (F.col("p") >= USUAL)).select("w", "c", "nc", "p")
    # words met once or twice that no single confusion explains: two, each of them usual
    left = types.where(~alien).withColumn("wh", _hash("w")).join(counts.where(F.col("n") <= TWICE_MOST).select(F.col("h").alias("wh"), F.col("n").alias("nw")), "wh")
    left = left.join(scored.select("w").distinct(), "w", "left_anti").select("w", "nw")
    more = left.mapInPandas(undo_twice, "w string, nw bigint, c string, ch bigint, how string").join(counts.select(F.col("h").alias("ch"), F.col("n").alias("nc")), "ch")
    each = [F.coalesce(F.try_element_at(F.create_map(*[x for k, v in prob.items() for x in (F.lit(k), F.lit(v))]), F.split("how", r"\+", -1)[i]), F.lit(0.0)) for i in (0, 1)]
    more = more.where(F.col("nc") >= LEAST * RATIO * F.col("nw")).where(F.least(*each) >= USUAL).select("w", "c", "nc", (each[0] * each[1]).alias("p"))
    scored = scored.unionByName(more)
    return scored.groupBy("w").agg(F.reverse(F.array_sort(F.collect_list(F.struct((F.col("nc") * F.col("p")).alias("s"), "c", "nc", "p")))).alias("cands")).select("w", F.transform("cands", lambda x: F.struct(x["c"].alias("c"), x["nc"].alias("nc"), x["p"].alias("p"))).alias("cands"))


def _hash(c: str) -> Column:
    @F.pandas_udf("bigint")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([hash_of(x) for x in s], dtype="int64")

    return of(F.col(c))


def decode(options: list[list[tuple[str, float, float]]], pair: dict[int, int], total: float) -> list[str]:
    """The likeliest printed words of a line: Viterbi over (word, its count, probability of the reading) per place."""
    best: list[tuple[float, list[int]]] = []
    for i, opts in enumerate(options):
        now = []
        for j, (w, n, p) in enumerate(opts):
            own = math.log(p) + math.log((n + 0.5) / total)
            if not i:
                now.append((own, [j]))
                continue
            h = hash_of(w)
            ways = []
            for (s, path), (v, nv, _) in zip(best, options[i - 1], strict=True):
                c = pair.get(bigram_hash(hash_of(v), h), 0)
                # seen pairs outweigh the word's own frequency, but not those of a rare word, which may be misread pairs
                step = math.log(0.7 * c / (max(nv, c) + PAIR_PRIOR) + 0.3 * (n + 0.5) / total)
                ways.append((s + math.log(p) + step, [*path, j]))
            now.append(max(ways))
        best = now
    return [options[i][j][0] for i, j in enumerate(max(best)[1])] if best else []


def repair_pages(rows: DataFrame, corpus: DataFrame | None = None, key: str = "id", text: str = "content", source: str = "source", page: str = "page") -> DataFrame:
    """``id, kinds, text``: every scanned page as continuous paragraphs, and the kinds of noise it had.

    ``rows``: the scanned pages, one per key (repeats of a key count once); ``corpus``: all texts that words
    are counted in, by default the pages. Kinds: ``hyphen``, ``chars``, ``header`` and ``pageno``, sorted.
    Null texts and keys are left out, an empty text stays empty. A null source is a source of its own; with a
    null page only decorated numbers are page numbers. Whole texts are read, of any length. Running heads are
    counted per source over all its pages, those of a source with very many pages in salted tasks.
    """
    col = lambda c: F.col(f"`{c}`")
    pages = rows.select(col(key).cast("bigint").alias("id"), F.coalesce(col(source), F.lit("")).alias("source"), col(page).cast("int").alias("page"), col(text).alias("content"))
    pages = cut_lineage(pages.where("id is not null and content is not null").dropDuplicates(["id"]))
    counts = cut_lineage(count_corpus(rows if corpus is None else corpus, text))
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / 2 + 1
    # words of a fixed share of the corpus: at most 2 / COMMON_SHARE of them
    common = {r["h"]: r["n"] for r in counts.where(F.col("n") >= max(1000.0, total * COMMON_SHARE)).collect()}
    pages = cut_lineage(pages.join(find_heads(pages), "id", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<int>"))))

    def apart(r) -> Page:
        return Page(r.content, None if pd.isna(r.page) else int(r.page), list(r.heads))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                out += [(r.id, w, h) for w in set(apart(r).asks()) if (h := hash_of(w)) not in common]
            yield pd.DataFrame(out, columns=["id", "w", "h"])

    answers = pages.mapInPandas(ask, "id bigint, w string, h bigint").join(counts, "h").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("asked"))
    pages = cut_lineage(pages.join(answers, "id", "left"))

    def joined(r) -> tuple[Page, bool]:
        p = apart(r)
        n = dict(r.asked) if r.asked is not None else {}
        n |= {w: common[h] for w in p.asks() if (h := hash_of(w)) in common}
        return p, p.join(n)

    def settled(w: str, memo: dict[str, bool]) -> bool:
        """A common word that is not a misreading of one far more common."""
        if w not in memo:
            n = common.get(hash_of(w))
            memo[w] = n is not None and not any(common.get(hash_of(c), 0) >= RATIO * n for c in readings(w))
        return memo[w]

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        for pdf in batches:
            out = [(r.id, w) for r in pdf.itertuples() for w in {w.lower() for line in joined(r)[0].words() for _, _, w in line} if not settled(w, memo)]
            yield pd.DataFrame(out, columns=["id", "w"])

    seen = cut_lineage(pages.mapInPandas(rare, "id bigint, w string"))
    wrong = cut_lineage(corrections(seen.select("w").distinct(), counts))
    fixes = seen.join(wrong, "w").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "cands"))).alias("fixes"))
    pages = cut_lineage(pages.join(fixes, "id", "left"))

    def lattice(p: Page, fixes: dict, count: Mapping[int, int]) -> Iterator[tuple[int, list, list]]:
        """Per line with a word in doubt: (line, its words, per word the (candidate, count, probability of the reading))."""
        for i, line in enumerate(p.words()):
            if not any(w.lower() in fixes or _figures_among_letters(w) for _, _, w in line):
                continue
            options = []
            for _, _, w in line:
                low = w.lower()
                alien = bool(_ALIEN.search(low))
                cands = [(c["c"], float(c["nc"]), max(1e-4, float(c["p"]) * 0.05)) for c in fixes.get(low, ())]
                if alien and not cands and _figures_among_letters(low):
                    # no word of the corpus: the likeliest reading is a word never met
                    cands = [(c, UNMET, 0.05) for c in list(readings(low))[:1]]
                n = float(count.get(hash_of(low), 1))
                if alien:
                    # as printed: a word of that form, the more likely the more often it is met
                    cands.append((low, n, PRINTED))
                elif low in fixes:
                    cands.insert(0, (low, 0.5, 0.5))
                else:
                    cands = [(low, n, 1.0)]
                options.append(cands)
            yield i, line, options

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for r in pdf.itertuples():
                for _, _, options in lattice(joined(r)[0], dict(r.fixes) if r.fixes is not None else {}, {}):
                    out |= {(r.id, h) for x in options for c in x if (h := hash_of(c[0])) not in common}
                    for a, b in zip(options, options[1:], strict=False):
                        if len(a) + len(b) > 2:
                            out |= {(r.id, h) for x in a for y in b if (h := bigram_hash(hash_of(x[0]), hash_of(y[0]))) not in common}
            yield pd.DataFrame(sorted(out), columns=["id", "h"])

    # the counts of the words of those lines, and of their pairs
    some = pages.where(F.col("fixes").isNotNull() | F.col("content").rlike(r"\p{L}[\d+|!$@€]|[\d+|!$@€]\p{L}")).mapInPandas(pairs, "id bigint, h bigint")
    likely = some.join(counts, "h").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("pairs"))
    pages = pages.join(likely, "id", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                p, divided = joined(r)
                kinds = [k for k, on in (("header", p.head), ("hyphen", divided), ("pageno", p.number)) if on]
                fixes = dict(r.fixes) if r.fixes is not None else {}
                pair = ChainMap(dict(r.pairs) if r.pairs is not None else {}, common)
                misread = False
                for i, line, options in lattice(p, fixes, pair):
                    printed = decode(options, pair, total)
                    x = p.lines[i]
                    for (a, b, w), c in sorted(zip(line, printed, strict=True), key=lambda z: -z[0][0]):
                        if c != w.lower():
                            misread = True
                            x = x[:a] + like(c, w) + x[b:]
                    p.lines[i] = x
                out.append((r.id, sorted([*kinds, "chars"] if misread else kinds), p.text()))
            yield pd.DataFrame(out, columns=["id", "kinds", "text"])

    return pages.mapInPandas(finish, "id bigint, kinds array<string>, text string").withColumnRenamed("id", key)


def _figures_among_letters(w: str) -> bool:
    """Figures or signs in a word of at least three letters, which are the greater part."""
    letters = sum(c.isalpha() for c in w)
    return letters >= 3 and bool(_ALIEN.search(w)) and letters > len(w) - letters
