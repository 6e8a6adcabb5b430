"""Broken prompt and response pairs: one defect per pair, or none.

Empty answers are what is left of nothing once markup, labels and placeholders are gone; copies are found by
greedy string tiling of each sentence with the question; refusals by a grammar over classes of words; another
language by the script of the letters and, within one script, by a word model fitted on all pairs; truncation by a pushdown parser
over fences, brackets, quotations, lists and markup, and by how the last sentence ends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sized
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage

#: What a function word counts beforehand in the word model, and how often a word must be seen to tell anything.
FUNCTION_COUNT, LEAST_COUNT = 20, 8
#: Share of an answer's words that must be unknown in the question's language, none being frequent there, if so many words are to be in a language that has no model.
UNKNOWN, UNKNOWN_WORDS = 0.8, 8
#: Log odds by which an answer's language must beat the question's.
LANGUAGE_ODDS = 3.0
#: Share of a sentence's words that the question's tiles must cover in a copy.
COPY_COVER = 0.75
#: An answer of so many words may do without a full stop.
PHRASE_WORDS = 4

# Frequent words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "the a an of at in for with was were is are has have had it its on by from because although since no not that to after before between and or which who what when why how did does do be been this these if until while under so as than then each every both",
    "de": "der die das den dem des und von für mit wurde wird wurden ist sind ein eine einer einem nicht in am im nach vor weil obwohl damit da seit bis zum zur warum wann welche wer wie auf bei zu noch sie es sich danach innerhalb siehe als auch dass oder",
    "fr": "le la les des du de et pour avec est sont un une il elle on faut en à au aux dans avant après car puisque que qui quand pourquoi quelle quel sans bien pendant depuis sur par ne pas ce cette afin dès voir ou ensuite",
    "es": "el la los las del de y para con es son un una se hay que en antes después porque ya aunque sin según tras durante desde por qué cuándo cuál quién como al lo no su sus este esta debe rige ver o mientras",
}
#: Words that no phrase ends with.
DANGLING = set("the a an of for with and or because although from into der die das den dem des ein eine einer und oder von für mit weil obwohl zum zur le la les des du un une et ou de pour avec parce el los las del y para con porque".split())
PLACEHOLDERS = {"null", "none", "nil", "nan", "n/a", "na", "n.a.", "tbd", "todo", "undefined", "empty", "missing", "placeholder", "no answer", "keine", "keine antwort", "k. a.", "k.a.", "entfällt", "néant", "aucune réponse", "sans réponse", "ninguno", "sin respuesta", "insert answer here", "your answer here", "answer here", "to be added", "lorem ipsum"}
LABELS = "answer|antwort|réponse|reponse|respuesta|response|reply|output|result|a|r"
#: What may stand before a question that is given back.
ECHO = (
    r"(?:q|re|f|p|question|frage|pregunta|the question (?:is|was)|you asked|your question|die frage (?:lautet|ist|war)|sie fragten|zur frage|la question (?:est|était)|à la question|vous demandez|"
    r"la pregunta (?:es|era)|a la pregunta|usted pregunta|preguntas)"
)
LANGUAGE_NAMES = r"\b(?:russian|chinese|greek|polish|italian|arabic|japanese|russisch\w*|chinesisch\w*|griechisch\w*|polnisch\w*|russe\w*|chinois\w*|grec\w*|polonais\w*|ruso|rusa|chino|china|griego|griega|polaco|polaca|english|german|french|spanish|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|anglais\w*|allemand\w*|français\w*|espagnol\w*|inglés\w*|ingles\w*|alem[aá]n\w*|francés\w*|frances\w*|español\w*|castellano|translat\w+|übersetz\w*|tradu\w+)\b"

_APOLOGY = (
    r"(?:(?:i'?m|i am|we are|we're) (?:very |so |really |terribly )?sorry|sorry|apologies|my apologies|i apologi[sz]e|unfortunately|regrettably|sadly|thank you for (?:asking|your question)(?: about [^,;:.]+)?|as an? (?:ai |large )*(?:language model|assistant|ai)|i'?m afraid|i am afraid|"
    r"es tut mir (?:sehr )?leid|tut mir leid|leider|entschuldigung|entschuldigen sie|bedaure|als (?:ki|sprachmodell|assistent)(?: sage ich)?|danke für (?:die|ihre) (?:frage|anfrage)(?: zu [^,;:.]+)?|"
    r"je suis (?:vraiment )?désolée?|désolée?|pardon|excusez-moi|malheureusement|en tant (?:que|qu')\s?(?:modèle de langue|modèle de langage|ia|assistant)|merci (?:pour|de) (?:votre|la) question(?: sur [^,;:.]+)?|je regrette|"
    r"lo siento(?: mucho)?|disculpe|disculpas|perdón|perdone|por desgracia|lamentablemente|desgraciadamente|como (?:modelo de lenguaje|asistente|ia)|gracias por (?:la|su) pregunta(?: sobre [^,;:.]+)?)"
)
# Classes of words that sentences which decline are made of; a star stands for any ending.
CLASSES = {
    "I": "i we ich wir je nous yo nosotros",
    "ME": "me us my our myself mir uns mich mein* unser* m moi mes notre nos mi mis nuestr*",
    "NOT": "not no nothing never neither nicht nichts kein* ne aucun* rien nada ningun* ningún tampoco",
    "UNABLE": "unable unwilling incapable",
    "CAN": "can could able may might must will would do does did wish want allowed permitted position willing prepared comfortable kann können könnte darf dürfen möchte möchten werde werden will vermag imstande bereit peux pouvons puis suis sommes veux souhaite saurais dois mesure",
    "PUEDO": "puedo podemos podría debo debemos quiero deseo soy estoy estamos",
    "POSSIBLE": "possible permitted allowed appropriate möglich erlaubt gestattet angemessen approprié posible permitido apropiado adecuado",
    "CABE": "cabe",
    "SAY": "answer* respon* reply help* assist* comment* shar* provid* disclos* discuss* say tell giv* fulfil* complet* comply elaborate advise engage go speak talk address process offer "
    "beantwort* antwort* helf* hilfe weiterhelf* auskunft äußer* sagen mitteil* geben nennen unterstütz* stellung* preisgeben besprechen eingehen "
    "répond* répon* aider dire fournir donner commenter partager traiter prononcer communiquer révéler parler contest* ayudar* decir dar opinar comentar compartir ofrecer proporcionar revelar hablar facilitar",
    "ANSWER": "answer response comment reply information antwort auskunft hilfe stellungnahme beantwortung réponse respuesta",
    "DECLINE": "decline declining refuse refusing pass abstain refrain ablehnen verzichten passen décliner refuser abstenir passer rechazar declinar abstenerme rehusar",
    "DECLINING": "décline refuse abstiens rechazo declino abstengo rehúso",
    "LEHNE": "lehne lehnen", "AB": "ab",
    "MUST": "must have need shall will would like wish respectfully politely to muss müssen möchte möchten dois devons souhaite préfère debo tengo que debemos quiero prefiero",
    "RATHER": "rather prefer lieber préfère préférons préférerais prefiero preferimos preferiría",
    "LEAVE": "leave unanswered skip unbeantwortet offenlassen",
    "TOPIC": "subject* topic* matter* question* thing* thema frage sujet tema pregunta",
    "RULE": "guideline* rule* instruction* policy policies programming training abilities capabilities scope richtlinien vorgaben regeln consignes directives règles directrices normas reglas pautas",
    "BAR": "keep* prevent* stop* forbid* prohibit* bar* not nicht ne no",
    "LET": "let allow permit enable erlaub* permet* autoris* suffi* permit* basta* alcanza*",
    "SOURCE": "context text passage* document* source* kontext abschnitt dokument angaben contexte texte contexto texto documento",
    "LITTLE": "insufficient enough little genug", "BEYOND": "against outside beyond außerhalb hors fuera", "BE": "be", "FOR": "for",
    "IMPOSSIBLE": "impossible imposible unmöglich", "NOCAN": "no", "JUSTCAN": "can", "JUSTDO": "do", "ES": "es está hay", "THIS": "this that it dazu hierzu",
}
#: Parts of the productions below that are written in several ways.
PARTS = {"CANNOT": ("CAN NOT", "NOT CAN", "UNABLE"), "RATHERNOT": ("RATHER NOT", "RATHER LEAVE", "NOT RATHER")}
#: The productions of a sentence that declines: classes in order, others between them; a number bounds how many.
PRODUCTIONS = (
    "I CANNOT SAY", "CAN I NOT SAY", "NOT 1 PUEDO SAY", "NOT 1 ME 1 ES POSSIBLE SAY", "NOT 0 ES 0 POSSIBLE SAY", "NOT 0 CABE SAY", "NOT ME 2 POSSIBLE SAY", "I 3 DECLINE", "I MUST DECLINE", "MUST 0 I DECLINE", "MUST 1 DECLINE", "I 1 DECLINING", "DECLINING", "ME 0 DECLINING",
    "I LEHNE AB", "LEHNE 0 I AB", "I 2 RATHERNOT", "RATHER 0 NOT", "RATHER 0 LEAVE", "TOPIC 1 I 0 CANNOT", "NOT 0 ANSWER CAN 0 BE", "POSSIBLE FOR 0 ME", "SAY CAN 0 NOT 1 POSSIBLE", "SAY NOT 1 POSSIBLE", "ANSWER ME NOT POSSIBLE",
    "ME 0 RULE BAR", "SOURCE NOT LET ME", "SOURCE ME NOT", "NOT 0 ME 1 LET", "LITTLE ME SAY", "NOT FOR 0 ME SAY", "BEYOND 0 ME 1 RULE", "BEYOND I CAN", "NOCAN 0 JUSTCAN 0 JUSTDO", "NOT 0 ANSWER", "IMPOSSIBLE SAY", "NOT 1 CAN 2 SAY 1 ANSWER ME",
)
_REFERRAL = (
    r"(?:please |kindly |instead,? |bitte |veuillez |por favor,? )*(?:consult|see|refer|rephrase|ask|contact|try|read|check|turn to|feel free|let me know|"
    r"abschnitt|fragen sie|lesen sie|wenden sie|siehe|formulieren sie|lire|voir|adressez-vous|consultez|reformulez|demandez|contactez|consulte|pregunte|lea|vea|reformule|contacte|diríjase|is there anything)\b"
)
_RE = {k: re.compile(v, re.IGNORECASE) for k, v in {"apology": rf"^\W*{_APOLOGY}(?=\W|$)[\s,:;!.—–-]*(?:but\b|aber\b|mais\b|pero\b)?\s*", "referral": rf"^\W*{_REFERRAL}"}.items()}
_ECHO = re.compile(rf"^[\s>*#\-–—•\"'“”«»(\[]*(?:{ECHO}\s*[:：]\s*)?", re.IGNORECASE)
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|\([^()]*\)|\[[^\[\]]*\]|`[^`]*`")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+|;\s+")
_MARKUP = re.compile(r"<[^<>]*>|&(?:nbsp|#\w+);")
_LABEL = re.compile(rf"^(?:{LABELS})\s*[:：]", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W_]+")
_UNSEEN = re.compile(r"[­​-‏‪-‮⁠-⁤﻿]")
_LIST = re.compile(r"^\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?=\s|$)")


def is_empty(answer: str | None) -> bool:
    """Nothing but white space, marks, markup, a label or a placeholder."""
    if answer is None:
        return True
    t = _UNSEEN.sub("", answer)
    if "<" in t or "&" in t:
        t = _MARKUP.sub(" ", t)
    t = t.strip().strip("[](){}<>\"'`*_#").strip()
    t = _LABEL.sub("", t).strip()
    if t.lower().strip("[](){}<>\"'`*_#-–—. ") in PLACEHOLDERS or t.lower() in PLACEHOLDERS:
        return True
    return not any(c.isalnum() for c in t)


def tile(a: list[str], b: list[str], least: int) -> list[bool]:
    """Greedy string tiling: which words of ``a`` lie in tiles, at least ``least`` words long, of words of ``b`` used once."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j : j + least]), []).append(j)
    while True:
        best, where = 0, (0, 0)
        i = 0
        while i <= len(a) - least:
            far = 0
            for j in at.get(tuple(a[i : i + least]), ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, where = n, (i, j)
                far = max(far, n)
            # inside a match no longer match begins
            i += max(1, far)
        if best < least:
            return used_a
        i, j = where
        used_a[i : i + best] = [True] * best
        used_b[j : j + best] = [True] * best


def is_copy(question: str, answer: str) -> bool:
    """Every sentence is the question again, perhaps slightly changed; labels before it aside."""
    q = _TOKEN.findall(question.lower())
    if not q:
        return False
    some, asked = False, set(q)
    for sentence in _SENTENCE.split(answer.strip()):
        words = _TOKEN.findall(_ECHO.sub("", sentence).lower())
        if not words:
            continue
        if len(words) * COPY_COVER > len(q):
            return False
        # tiles cover no word that the question does not have
        if sum(w in asked for w in words) < COPY_COVER * len(words):
            return False
        least = min(3, len(words), len(q))
        hit = tile(words, q, least)
        # what the question does not say, above all a figure or a code, is an answer
        if sum(hit) < COPY_COVER * len(words) or any(any(c.isdigit() for c in w) and w not in q for w in words):
            return False
        some |= len(words) * 2 >= len(q)
    return some


_WHOLE = {w: {c for c, v in CLASSES.items() if w in v.split()} for v in CLASSES.values() for w in v.split() if not w.endswith("*")}
_STEMS = [(w[:-1], c) for c, v in CLASSES.items() for w in v.split() if w.endswith("*")]
#: Contractions of English; what is elided in French stands before the apostrophe.
_PARTED = {"can't": "can not", "cannot": "can not", "won't": "will not", "i'd": "i would", "i'm": "i am", "i'll": "i will", "we're": "we are", "we'd": "we would", "we'll": "we will", "n": "ne", "j": "je"}


@cache
def classes_of(word: str) -> frozenset[str]:
    return frozenset(_WHOLE.get(word, set()) | {c for stem, c in _STEMS if word.startswith(stem)})


def _productions() -> list[list[tuple[int, str]]]:
    """Every production as (words allowed before, class), its parts written out."""
    out = []
    for rule in PRODUCTIONS:
        ways = [rule]
        for part, alternatives in PARTS.items():
            ways = [f" {w} ".replace(f" {part} ", f" {a} ").strip() for w in ways for a in (alternatives if f" {part} " in f" {w} " else [""])]
        for w in ways:
            gap, rules = 1 << 30, []
            for x in w.split():
                if x.isdigit():
                    gap = int(x)
                else:
                    rules.append((gap, x))
                    gap = 1 << 30
            out.append(rules)
    return out


_RULES = _productions()
#: Without a word of these classes no production is met.
_NEEDED = {"NOT", "UNABLE", "DECLINE", "DECLINING", "LEHNE", "RATHER", "IMPOSSIBLE", "LITTLE", "BEYOND", "RULE", "POSSIBLE"}


def declines(sentence: str) -> bool:
    """Is one of the productions met by the words of a sentence?"""
    words = []
    for w in _PART.findall(sentence.lower()):
        if w in _PARTED:
            words += _PARTED[w].split()
        elif w.endswith("n't"):
            words += [w[:-3], "not"]
        elif "'" in w:
            a, b = w.split("'", 1)
            words += [_PARTED.get(a, a), b]
        else:
            words.append(w)
    is_ = [classes_of(w) for w in words]
    have = frozenset().union(*is_)
    if not have & _NEEDED:
        return False
    at: dict[str, list[int]] = {}
    for i, c in enumerate(is_):
        for x in c:
            at.setdefault(x, []).append(i)
    for rule in _RULES:
        if any(c not in have for _, c in rule):
            continue
        ends = at[rule[0][1]]
        for gap, c in rule[1:]:
            # the earliest place after any end so far; with a bound, every place within it
            ends = [j for j in at[c] if any(0 < j - i <= gap + 1 for i in ends)] if gap < 1 << 30 else [j for j in at[c] if j > ends[0]]
            if not ends:
                break
        if ends:
            return True
    return False


def is_refusal(answer: str) -> bool:
    """Each sentence declines, apologises or refers elsewhere, and at least one declines."""
    declined = False
    for sentence in re.split(r"(?<=[.!?…])\s+|\n+|;\s*", _UNSEEN.sub("", answer).replace("’", "'").strip()):
        rest = sentence.strip()
        before = None
        while rest != before:
            before, rest = rest, _RE["apology"].sub("", rest, count=1)
        if not any(c.isalnum() for c in rest):
            continue
        if declines(rest):
            declined = True
        elif not _RE["referral"].match(rest):
            return False
    return declined


_LANGUAGES_OF = {w: [i for i, v in enumerate(FUNCTION_WORDS.values()) if w in v.split()] for v in FUNCTION_WORDS.values() for w in v.split()}


def count_words(texts: Iterable[str]) -> dict[str, Counter]:
    """The words of texts by language; a text is of the language whose function words lead by two."""
    counts: dict[str, Counter] = {k: Counter() for k in FUNCTION_WORDS}
    languages = list(FUNCTION_WORDS)
    for t in texts:
        found = [w.lower() for w in _WORD.findall(_QUOTED.sub(" ", t))]
        votes = [0] * len(languages)
        for w in found:
            for i in _LANGUAGES_OF.get(w, ()):
                votes[i] += 1
        second, first = sorted(votes)[-2:]
        if first >= second + 2:
            counts[languages[votes.index(first)]].update(found)
    return counts


class WordModel:
    """Naive Bayes over words, by language; unknown words say nothing."""

    def __init__(self, texts: list[str]) -> None:
        counts = count_words(texts)
        self._fit(counts, {k: sum(c.values()) for k, c in counts.items()}, {w for c in counts.values() for w in c if w not in _LANGUAGES_OF})

    @classmethod
    def of(cls, counts: dict[str, Counter], size: dict[str, int], others: int) -> WordModel:
        """The model of counts by language, of which words that are too rare may be left out; ``size``: all words' sum, ``others``: how many words are not function words."""
        model = cls.__new__(cls)
        model._fit(counts, size, range(others))
        return model

    def _fit(self, counts: dict[str, Counter], size: dict[str, int], others: Sized) -> None:
        self.frequent = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
        self.languages = list(FUNCTION_WORDS)
        counts = {k: counts[k] + Counter(dict.fromkeys(v, FUNCTION_COUNT)) for k, v in self.frequent.items()}
        size = {k: size[k] + FUNCTION_COUNT * len(v) for k, v in self.frequent.items()}
        n = len(others) + len(_LANGUAGES_OF)
        total = Counter()
        for c in counts.values():
            total.update(c)
        # words seen often enough to tell anything
        self.odds = {w: [math.log((counts[k][w] + 0.5) / (size[k] + 0.5 * n)) for k in self.languages] for w, m in total.items() if m >= LEAST_COUNT}

    def scores(self, words: list[str]) -> dict[str, float]:
        known = [o for w in words if (o := self.odds.get(w))]
        return dict(zip(self.languages, map(sum, zip(*known, strict=True)), strict=True)) if known else dict.fromkeys(self.languages, 0.0)


# The scripts told apart, by the code points that begin and end them.
SCRIPTS = (
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("greek", 0x1F00, 0x1FFF),
    ("east asian", 0x1100, 0x11FF), ("east asian", 0x3040, 0x30FF), ("east asian", 0x3400, 0x9FFF), ("east asian", 0xAC00, 0xD7A3), ("east asian", 0x20000, 0x3FFFF),
)


#: A letter that may be of another script than Latin.
_FAR = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u3040-\ud7a3\U00020000-\U0003ffff]")


def plain_words(text: str) -> list[str]:
    """The words outside quotations and brackets, in small letters."""
    return _WORD.findall(_QUOTED.sub(" ", text).lower())


def script_of(text: str) -> tuple[str | None, int]:
    """(the script of most letters outside quotations, how many letters it has); letters of no other script count as Latin."""
    n: Counter = Counter()
    for w in _WORD.findall(text if text.isascii() else _QUOTED.sub(" ", text)):
        if w.isascii():
            n["latin"] += len(w)
        else:
            for c in w:
                cp = ord(c)
                n["latin" if cp < 0x370 else next((s for s, a, b in SCRIPTS if a <= cp <= b), "latin")] += 1
    return max(n.items(), key=lambda x: (x[1], x[0]), default=(None, 0))


def is_other_language(model: WordModel, question: str, answer: str) -> bool:
    def fine() -> bool:
        # a foreign word that was asked for
        return bool(re.search(LANGUAGE_NAMES, question, re.IGNORECASE)) and len(_WORD.findall(answer)) <= len(_WORD.findall(question))

    if _FAR.search(answer) or _FAR.search(question):
        (asked_in, n), (given_in, m) = script_of(question), script_of(answer)
        if asked_in != given_in and n and m > 1:
            return not fine()
    asked = model.scores(plain_words(question))
    best = max(asked, key=lambda k: asked[k])
    rest = sorted((v for k, v in asked.items() if k != best), reverse=True)
    if asked[best] - rest[0] < 1.0:  # no language to speak of
        return False
    words = plain_words(answer)
    given = model.scores(words)
    found = max(given, key=lambda k: given[k])
    if found == best or given[found] - given[best] < LANGUAGE_ODDS:
        # a language without a model: nearly all words unknown, and none of the frequent ones of the question's
        if len(words) < UNKNOWN_WORDS or any(w in model.frequent[best] for w in words):
            return False
        return sum(w not in model.odds for w in words) >= UNKNOWN * len(words) and not fine()
    return not fine()


_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“”", "‹": "›"}
_CLOSE = {c for v in _PAIRS.values() for c in v}


#: What the parser stops at; everything between is skipped.
_MARK = re.compile(r"```|[`\"<(\[{«“„‹)\]}»”›\n]")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_HALF_TAG = re.compile(r"</?[a-zA-Z][\w-]*\s?[^<>\n]*\Z")


class Item(NamedTuple):
    """A list on the stack: the depth and kind of its marks, and what its items hold so far."""

    indent: int
    kind: str
    items: list[str]


def parse(text: str) -> tuple[list[str], list[Item]]:
    """The two ends of the pushdown parser's stack after the whole text: fences, brackets, quotations and tags still open, and the lists that the last line is in.

    A line with a list's mark closes the deeper lists and adds to, or opens, one at its depth; a line without closes those it is not indented under.
    """
    stack: list[str] = []
    lists: list[Item] = []
    i, n = 0, len(text)
    line = 0
    while line <= n:  # the line's own list first, then what stands in it
        end = text.find("\n", line)
        end = n if end < 0 else end
        row = text[line:end]
        if not stack or stack[-1] != "```":
            m = _LIST.match(row)
            if m:
                mark = m[0].strip()
                indent, kind = len(row) - len(row.lstrip()), "1" if any(c.isalnum() for c in mark) else mark
                while lists and (lists[-1].indent > indent or (lists[-1].indent == indent and lists[-1].kind != kind)):
                    lists.pop()
                if not lists or lists[-1].indent < indent:
                    lists.append(Item(indent, kind, []))
                lists[-1].items.append(row[m.end() :].strip())
            elif row.strip():
                indent = len(row) - len(row.lstrip())
                while lists and lists[-1].indent >= indent:
                    lists.pop()
                if lists:
                    lists[-1].items[-1] += " " + row.strip()
        i = line
        while m := _MARK.search(text, i, end):
            c, i = m[0], m.end()
            if c == "```":
                stack.pop() if stack and stack[-1] == "```" else stack.append("```")
            elif stack and stack[-1] == "```":
                continue
            elif c == "`":
                stack.pop() if stack and stack[-1] == "`" else stack.append("`")
            elif c == '"':
                # 12" is a measure
                if not (m.start() and text[m.start() - 1].isdigit() and '"' not in stack):
                    stack.pop() if stack and stack[-1] == '"' else stack.append('"')
            elif c == "<":
                if t := _TAG.match(text, m.start()):
                    name = "<" + t[2].lower()
                    if t[1]:
                        if name in stack:
                            del stack[len(stack) - 1 - stack[::-1].index(name) :]
                    elif not t[3] and t[2].lower() not in ("br", "hr", "img", "li", "p"):
                        stack.append(name)
                    i = t.end()
                    if i > end:
                        end = text.find("\n", i)
                        end = n if end < 0 else end
                elif _HALF_TAG.match(text, m.start()):
                    stack.append("<")
            elif stack and c in _PAIRS.get(stack[-1], ""):
                stack.pop()
            elif c in _PAIRS:
                stack.append(c)
            elif c in _CLOSE and any(c in _PAIRS.get(s, "") for s in stack):
                while c not in _PAIRS.get(stack[-1], ""):
                    stack.pop()
                stack.pop()
        line = end + 1
    return stack, lists


def open_ends(text: str) -> list[str]:
    """Fences, brackets, quotations and tags that the text leaves open."""
    return parse(text)[0]


def is_truncated(answer: str) -> bool:
    """It breaks off: something stays open, the last list item is bare, or its last sentence has no end."""
    t = _UNSEEN.sub("", answer).rstrip()
    stack, lists = parse(t)
    if stack or (lists and not lists[-1].items[-1]):
        return True
    t = re.sub(r"(?:<[^<>]*>|[*_`\"'”»)\]}’])+$", "", t).rstrip()
    if t.endswith(("…", "...", ",", ";", ":", "-", "–", "—", "(", "/", "&", "+", "=")):
        return True
    if t.endswith((".", "!", "?", "。", "！", "？", "।", "؟")):
        return False
    last = t.rsplit("\n", 1)[-1]
    body = lists[-1].items[-1] if lists else last
    words = _TOKEN.findall(body)
    if not words or words[-1].lower() in DANGLING:
        return True
    if lists and len(lists[-1].items) > 1:
        # lists of phrases have no full stops; a list of sentences has
        return any(re.search(r"[.!?]$", x) for x in lists[-1].items[:-1])
    # a phrase of a few words; more than one sentence makes the last a sentence too
    return len(body.split()) > PHRASE_WORDS or len([x for x in t.split("\n") if x.strip()]) > 1 or re.search(r"[.!?]\s", body) is not None


def defect_of(model: WordModel, question: str | None, answer: str | None) -> str | None:
    """The one defect of a pair; the first that holds of empty, copy, refusal, language and truncated."""
    if is_empty(answer):
        return "empty"
    q = question or ""
    if is_copy(q, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_other_language(model, q, answer):
        return "language"
    return "truncated" if is_truncated(answer) else None


def fit_words(df: DataFrame, question: str = "question", answer: str = "answer") -> WordModel:
    """The word model of all pairs: words are counted in the tasks and summed; only those seen LEAST_COUNT times reach the driver."""
    languages = list(FUNCTION_WORDS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = count_words(t for c in ("q", "a") for t in pdf[c] if t)
            words = sorted(set().union(*counts.values()))
            yield pd.DataFrame({"word": pd.Series(words, dtype="object")} | {k: pd.Series([counts[k][w] for w in words], dtype="int64") for k in languages})

    some = df.select(F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a"))
    each = some.mapInPandas(count, "word string, " + ", ".join(f"{k} bigint" for k in languages))
    words = cut_lineage(each.groupBy("word").agg(*[F.sum(k).alias(k) for k in languages]))
    known = F.col("word").isin(list(_LANGUAGES_OF))
    size = words.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in languages], F.count(F.when(~known, 1)).alias("others")).first()
    rows = words.where(known | (sum(F.col(k) for k in languages) >= LEAST_COUNT)).collect()
    return WordModel.of({k: Counter({r["word"]: r[k] for r in rows}) for k in languages}, size.asDict(), size["others"])


def find_defects(df: DataFrame, key: str = "id", question: str = "question", answer: str = "answer", model: WordModel | None = None) -> DataFrame:
    """``key, defect`` of the defective pairs, one row each.

    A null, or in effect empty, answer is ``empty`` whatever the question; with a null or empty question an
    answer can be no copy and in no other language. Repeated rows give repeated results. Whole texts are
    parsed, however long. The word model is fitted on all pairs, of which only counts of words are shuffled; all
    rules look at single pairs, so the table never is.
    """
    model = model or fit_words(df, question, answer)

    @F.pandas_udf("string")
    def defect(q: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([defect_of(model, x, y) for x, y in zip(q, a, strict=True)], dtype="object")

    out = df.select(F.col(f"`{key}`"), defect(F.col(f"`{question}`"), F.col(f"`{answer}`")).alias("defect"))
    return out.where("defect is not null")
