"""Text scalars as column expressions; Python runs only where the JVM has no equal (NFKC, arithmetic)."""

from __future__ import annotations

import ast
import operator
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
ROLE_LINE = r"(?im)^(system\s*:|assistant\s*:|<\|im_start\||<\|system\||ignore (all |previous |above )?(instructions?|rules?|system prompt))"
ROLE_ANYWHERE = r"(?i)(system\s*:|assistant\s*:|<\|im_start\||<\|system\||ignore (all |previous |above )?(instructions?|rules?|system prompt))"
ROLE_LABEL = r"(?i)\b(system|assistant)\s*:\s*"
SPECIFIC_REFERENCE = r"\b\d+\.\d+|\bcl\w+\s+\d+|v\d+\.\d+|clause\s+\d+|section\s+\d+"
CODE_OR_ERROR = r"[A-Z]{2,}[-_]\d+|error\s+\w+|error\s+code"
EXACT_PHRASE = r'"[^"]+"'
NO_HYDE = (r"\b\d+\.\d+", r"\b[A-Z]+-\d+", r"clause\s+\d+", r"section\s+\d+", r"article\s+\d+", r"error\s+\w+", r"error\s+code", r"'[A-Z_]{3,}'", r'"[^"]+"')
NO_CONTENT = ("no documents found", "no relevant documents", "document search error", "calculator error")
LEAD_INS = r"(?i)^(I need to find|Let's search for|I should look for|Search for|Next, I need to know)\s+"
FINAL_ANSWER = r"(?is)FINAL\s+ANSWER\s*:\s*(.*)"
ACTION = r"""(?is)Action\s*:\s*(search|calculate)\s*\(\s*['"]?(.*?)['"]?\s*\)"""
MAX_QUERY_CHARS = 2000
EMPTY_QUERY = "[empty query after sanitisation]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x) for x in s], dtype="object")

    return normalise(c)


def words(c: Column) -> Column:
    """Tokens between white space, lower-cased; punctuation stays."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != ""))


def clean_text(c: Column, least: int = 15) -> Column:
    """NFKC, single spaces, no page marks and addresses; texts under ``least`` characters (and null) become empty."""
    t = F.regexp_replace(nfkc(c), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?iU)\bPage\s+\d+\b", "")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", "")
    return F.when(F.length(strip(c)) >= least, strip(t)).otherwise("")


def clean_ascii(c: Column, least_words: int = 15) -> Column:
    """The older cleaning: also without mail addresses, telephone numbers and anything beyond ASCII."""
    t = F.regexp_replace(c, r"(?U)\s+", " ")
    for pattern, to in ((r"(?i)Page \d+", ""), (r"\S+@\S+", ""), (r"\+?\d[\d\s\-]{7,}", ""), (r"http\S+|www\S+", ""), (r"[^\x00-\x7F]+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.when(word_count(c) >= least_words, strip(t)).otherwise("")


def doc_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_length(c: Column) -> Column:
    """The tokenizer-free estimate: a token per four characters."""
    return F.floor(F.length(c) / 4).cast("int")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?]) +")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def sanitise_input(c: Column) -> tuple[Column, Column]:
    """(text, warnings): at most MAX_QUERY_CHARS characters, without lines that pose as another role."""
    t = strip(c)
    cut = F.length(t) > MAX_QUERY_CHARS
    t = F.substring(t, 1, MAX_QUERY_CHARS)
    posed = t.rlike(ROLE_LINE)
    clean = strip(F.regexp_replace(strip(F.regexp_replace(t, ROLE_LINE, "")), ROLE_LABEL, ""))
    out = F.when(posed, clean).otherwise(t)
    return F.when(out == "", EMPTY_QUERY).otherwise(out), F.array_compact(F.array(F.when(cut, "truncated"), F.when(posed, "role_injection")))


def sanitise_query(c: Column) -> Column:
    return strip(F.regexp_replace(c, ROLE_ANYWHERE, "[FILTERED]"))


def select_alpha(c: Column, is_complex: Column) -> Column:
    """Weight of the dense ranking: 0.2 for questions with exact references, 0.75 for complex ones, else 0.55."""
    w = words(c)
    exact = F.lower(c).rlike(SPECIFIC_REFERENCE) | c.rlike(CODE_OR_ERROR) | c.rlike(EXACT_PHRASE)
    short = (F.size(F.array_distinct(w)) < 5) & (F.size(w) >= 2)
    return F.when(exact, 0.2).when(is_complex & ~short, 0.75).otherwise(0.55)


def use_hyde(c: Column) -> Column:
    return ~c.rlike("(?i)" + "|".join(f"(?:{p})" for p in NO_HYDE))


def is_useful(c: Column) -> Column:
    low = strip(F.lower(c))
    empty = F.lit(False)
    for phrase in NO_CONTENT:
        empty = empty | F.contains(low, F.lit(phrase))
    return (F.length(low) >= 30) & ~empty


def bridge_query(c: Column) -> Column:
    """The last sentence of a line of reasoning, without its lead-in."""
    t = strip(c)
    parts = F.filter(F.split(t, r"[.!?]+(?:\s+|$)"), lambda p: strip(p) != "")
    last = F.when(F.size(parts) > 0, strip(F.try_element_at(parts, F.lit(-1)))).otherwise(t)
    return F.when(t == "", "").otherwise(strip(F.regexp_replace(last, LEAD_INS, "")))


def parse_action(c: Column) -> Column:
    """struct(final, action, input) of a step of reasoning; null where absent."""
    final = F.when(c.rlike(FINAL_ANSWER), strip(F.regexp_extract(c, FINAL_ANSWER, 1)))
    acts = c.rlike(ACTION)
    return F.struct(final.alias("final"), F.when(acts, F.lower(F.regexp_extract(c, ACTION, 1))).alias("action"), F.when(acts, strip(F.regexp_extract(c, ACTION, 2))).alias("input"))


def unfence(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def parse_json(c: Column, schema: str) -> Column:
    """Fenced JSON to a struct; null if it is none."""
    return F.from_json(unfence(c), schema)


def parse_grade(c: Column) -> Column:
    """EXACT, IRRELEVANT or AMBIGUOUS, in this order of search, as the grader's text mentions them."""
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(F.contains(up, F.lit("EXACT")), "EXACT").when(F.contains(up, F.lit("IRRELEVANT")), "IRRELEVANT").otherwise("AMBIGUOUS")


def plan_lines(c: Column, question: Column, most: int = 5) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.slice(F.concat(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[- ]+|[- ]+$", ""))), F.array(question)), 1, most)


def hyde_parts(c: Column, most: int = 2) -> Column:
    return F.slice(F.filter(F.transform(F.split(c, r"\|\|\|"), strip), lambda x: x != ""), 1, most)


def keyword_overlap(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(words(query), words(text)))


def snippet(source: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("["), basename(source), F.lit(" p."), F.coalesce(page.cast("string"), F.lit("?")), F.lit("]: "), F.substring(text, 1, 500))


def citation(source: Column, page: Column) -> Column:
    """One entry of a list of sources; a page of 0 or null is left out."""
    return F.concat(F.lit("• "), F.coalesce(F.when(source != "", basename(source)), F.lit("Unknown")), F.when(page != 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise("").alias("p") if page is not None else F.lit(""))


def cache_key(question: Column, history: Column) -> Column:
    """Key of an answer: the question and the last two messages (an array of strings)."""
    return F.sha2(F.concat(question, F.lit("::"), F.to_json(history)), 256)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.USub: operator.neg}


def calculate(expression: str) -> str:
    """Arithmetic over figures with + - * / % ** and brackets, rounded to six digits; anything else is an error text."""

    def value(node: ast.AST) -> float:
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return v
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                base, power = value(a), value(b)
                if abs(power) > 1000:
                    raise ValueError("exponent too large")
                return base**power
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](value(a), value(b))
        raise ValueError(f"Unsupported expression: {ast.dump(node)}")

    try:
        return str(round(value(ast.parse(expression.strip(), mode="eval").body), 6))
    except Exception as e:  # noqa: BLE001
        return f"Calculator error: {e}"


def calculator(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else calculate(x) for x in s], dtype="object")

    return run(c)
