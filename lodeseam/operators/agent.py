"""Answering in steps: grading, checking, and loops that run one batch per step over all open questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.text import bridge_query, calculator, is_useful, parse_action, words
from lodeseam.operators.judge import is_complex
from lodeseam.providers import LLMProvider, complete
from lodeseam.session import cut_lineage

MAX_STEPS = 6
EXACT_SHARE, RELATED_SHARE = 0.8, 0.3
NOTHING_FOUND = "No relevant information was found for this question."
# Sentences that need no support.
CONNECTIVES = ("additionally,", "in summary", "in summary,", "moreover,", "furthermore,", "in conclusion", "in conclusion,", "to summarize", "to summarize,", "therefore,")


def grade(question: Column, context: Column) -> Column:
    """The offline grader: by the share of the question's words in the context."""
    q = F.array_distinct(words(question))
    share = F.size(F.array_intersect(q, words(F.coalesce(context, F.lit(""))))) / F.size(q)
    return F.when(F.coalesce(context, F.lit("")) == "", "IRRELEVANT").when(share >= EXACT_SHARE, "EXACT").when(share >= RELATED_SHARE, "AMBIGUOUS").otherwise("IRRELEVANT")


def mark_unverified(sentence: Column, similarity: Column, threshold: float = 0.75) -> Column:
    """A sentence whose best similarity to the chunks is too low is marked; short ones and connectives never."""
    s = F.trim(sentence)
    free = (F.length(s) < 15) | F.lower(s).isin(*CONNECTIVES)
    return F.when(free | (F.coalesce(similarity, F.lit(-1.0)) >= threshold), sentence).otherwise(F.concat(F.lit("[Unverified] "), s))


class ScriptedReasoner(LLMProvider):
    """The offline reasoner: search for the question, then, ``hops`` times in all, for what the last observation begins with; then answer with what was observed."""

    def __init__(self, hops: int = 1) -> None:
        self.hops = hops

    def complete(self, prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            question, *seen = p.split("\nObservation: ")
            seen = [s.strip() for s in seen if s.strip()]
            if len(seen) >= self.hops:
                out.append("Thought: enough is known.\nFINAL ANSWER: " + "\n".join(seen))
                continue
            ask = " ".join(seen[-1].replace('"', " ").replace("(", " ").replace(")", " ").split()[:12]) if seen else question.removeprefix("Question: ").split("\n")[0]
            out.append(f'Thought: {"this leads on" if seen else "look it up"}.\nAction: search("{ask}")')
        return out


def run_react(questions: DataFrame, search: Callable[[DataFrame], DataFrame], provider: LLMProvider | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """``query_id, answer, steps``: thought, action and observation by turns, for all questions at once.

    ``search`` turns ``query_id, query`` into ``query_id, observation``. Each step is one batch over the
    questions still open, written before the next; a step without an action is the answer, and after
    ``max_steps`` the observations are.
    """
    steps_type = "array<struct<thought:string,action:string,observation:string>>"
    open_ = cut_lineage(questions.select("query_id", "query", F.concat(F.lit("Question: "), "query").alias("prompt"), F.array().cast(steps_type).alias("steps")))
    done: list[DataFrame] = []
    for _ in range(max_steps):
        told = open_.withColumn("out", complete(F.col("prompt"), provider or ScriptedReasoner()))
        told = cut_lineage(told.withColumn("a", parse_action(F.col("out"))))
        ends = told.where("a.final is not null or a.action is null")
        done.append(ends.select("query_id", F.coalesce("a.final", "out", F.lit(NOTHING_FOUND)).alias("answer"), "steps"))
        acts = told.where("a.final is null and a.action is not null")
        if acts.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)
        computed = acts.where("a.action = 'calculate'").select("query_id", F.concat(F.lit("Calculator result: "), calculator(F.col("a.input"))).alias("observation"))
        found = search(acts.where("a.action = 'search'").select("query_id", F.col("a.input").alias("query")))
        seen = acts.join(computed.unionByName(found.select("query_id", "observation")), "query_id", "left")
        obs = F.coalesce("observation", F.lit("No documents found."))
        thought = F.regexp_replace(F.regexp_extract("out", r"(?is)^(.*?)Action\s*:", 1), r"(?i)^\s*Thought\s*:\s*|\s+$", "")
        step = F.struct(thought.alias("thought"), F.concat(F.col("a.action"), F.lit("("), F.col("a.input"), F.lit(")")).alias("action"), obs.alias("observation"))
        open_ = cut_lineage(seen.select("query_id", "query", F.concat("prompt", F.lit("\nObservation: "), obs).alias("prompt"), F.array_append("steps", step).alias("steps")))
    forced = F.array_join(F.transform("steps", lambda s: s["observation"]), "\n\n")
    done.append(open_.select("query_id", F.when(forced != "", forced).otherwise(NOTHING_FOUND).alias("answer"), "steps"))
    return reduce(DataFrame.unionByName, done)


def run_ircot(questions: DataFrame, search: Callable[[DataFrame], DataFrame], provider: LLMProvider | None = None, max_steps: int = MAX_STEPS, end: str = "Therefore, the answer is:") -> DataFrame:
    """``query_id, answer, n_steps``: reasoning interleaved with retrieval; the last sentence of each thought is the next query."""
    open_ = cut_lineage(questions.select("query_id", "query", F.col("query").alias("ask"), F.lit("").alias("context"), F.lit(0).alias("n_steps")))
    done: list[DataFrame] = []
    for _ in range(max_steps):
        found = search(open_.select("query_id", F.col("ask").alias("query"))).select("query_id", "observation")
        step = open_.join(found, "query_id", "left").withColumn("context", F.concat_ws("\n", "context", "observation")).drop("observation")
        step = cut_lineage(step.withColumn("n_steps", F.col("n_steps") + 1).withColumn("thought", complete(F.concat(F.lit("Question: "), "query", F.lit("\nObservation: "), "context"), provider or ScriptedReasoner())))
        ended = F.contains(F.lower("thought"), F.lit(end.lower())) | F.col("thought").rlike(r"(?i)final\s+answer\s*:") | F.col("thought").isNull()
        answer = F.regexp_extract("thought", r"(?is)(?:therefore, the answer is:|final\s+answer\s*:)\s*(.*)", 1)
        done.append(step.where(ended).select("query_id", F.coalesce(answer, F.lit(NOTHING_FOUND)).alias("answer"), "n_steps"))
        open_ = cut_lineage(step.where(~ended).select("query_id", "query", bridge_query(F.col("thought")).alias("ask"), "context", "n_steps"))
        if open_.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)
    done.append(open_.select("query_id", F.when(F.col("context") != "", F.col("context")).otherwise(NOTHING_FOUND).alias("answer"), "n_steps"))
    return reduce(DataFrame.unionByName, done)


def plan_execute(plans: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``question_id, answer``: the steps of each plan (``question_id, steps``) searched at once, their useful observations joined."""
    each = plans.select("question_id", F.posexplode("steps").alias("no", "query")).withColumn("query_id", F.xxhash64("question_id", "no"))
    figures = F.regexp_extract_all("query", F.lit(r"[\d\s+\-*/().%]*\d[\d\s+\-*/().%]*"), F.lit(0))
    longest = F.try_element_at(F.array_sort(figures, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    sums = F.col("query").rlike(r"(?i)\b(calculate|compute|math)\b") & longest.isNotNull()
    each = cut_lineage(each.withColumn("figures", F.when(sums, F.trim(longest))))
    found = search(each.where("figures is null").select("query_id", "query")).select("query_id", "observation")
    seen = each.join(found, "query_id", "left").withColumn("o", F.coalesce("observation", F.when(F.col("figures").isNotNull(), calculator(F.col("figures"))), F.lit("")))
    useful = seen.where(is_useful(F.col("o")) | (F.col("figures").isNotNull() & ~F.startswith("o", F.lit("Calculator error"))))
    joined = useful.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "o"))), lambda s: s["o"]), "\n\n").alias("answer"))
    return plans.select("question_id").join(joined, "question_id", "left").select("question_id", F.coalesce("answer", F.lit(NOTHING_FOUND)).alias("answer"))


def run_agent(questions: DataFrame, search: Callable[[DataFrame], DataFrame], mode: str = "react", provider: LLMProvider | None = None, least: int = 50) -> DataFrame:
    """``query_id, answer, way``: complex questions by the loop of ``mode`` (``react`` or ``ircot``), if its answer has more than ``least`` characters; all others by plan.

    A plan is the numbered lines that a complex question holds, or the question alone. ``way`` is ``react``, ``ircot`` or ``plan``.
    """
    if mode not in ("react", "ircot"):
        raise ValueError("mode must be react or ircot")
    q = cut_lineage(questions.select("query_id", "query", is_complex(F.col("query")).alias("complex")))
    hard = q.where("complex")
    loop = run_react if mode == "react" else run_ircot
    tried = loop(hard, search, provider).select("query_id", "answer").where((F.length("answer") > least) & (F.col("answer") != NOTHING_FOUND))
    tried = cut_lineage(tried)
    rest = q.join(tried, "query_id", "left_anti")
    lines = F.filter(F.split("query", "\n"), lambda x: F.trim(x) != "")
    plans = rest.select(F.col("query_id").alias("question_id"), F.when(F.col("complex") & (F.size(lines) > 1), lines).otherwise(F.array("query")).alias("steps"))
    planned = plan_execute(plans, search).select(F.col("question_id").alias("query_id"), "answer", F.lit("plan").alias("way"))
    return tried.withColumn("way", F.lit(mode)).unionByName(planned)
