"""Rewards by name over a table of responses, and lists of them with weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import rewards as R
from veritrace.functions import text as X
from veritrace.functions.rules import LABEL_RULES
from veritrace.operators import conformance, eventlog, grading
from veritrace.operators.joins import token_f1
from veritrace.session import deal, materialize

#: What a reward is given: the responses with ``id``, ``response`` and ``gold``, and what is made for several of them
#: (``n_rows``: the number of responses, by which rows are dealt over tasks).
Context = dict[str, DataFrame | int]
Job = Callable[[DataFrame, str, Context], DataFrame]
#: Rewards that need more than their row: each gives the key and ``value``.
JOBS: dict[str, Job] = {}


def job(name: str) -> Callable[[Job], Job]:
    def register(fn: Job) -> Job:
        JOBS[name] = fn
        return fn
    return register


def verdicts(df: DataFrame, key: str, context: Context) -> DataFrame:
    """Grades of the responses, made once for all rewards that ask."""
    if "verdicts" not in context:
        profile = F.col("profile") if "profile" in df.columns else "default"
        context["verdicts"] = materialize(grading.grade(df, [key], profile=profile).select(key, "correct"), "reward-verdicts")
    return context["verdicts"]


@job("accuracy")
def accuracy(df: DataFrame, key: str, context: Context) -> DataFrame:
    """1 for a response that its data set's cascade accepts, else 0."""
    return deal(verdicts(df, key, context), context["n_rows"], key).select(key, F.col("correct").cast("double").alias("value"))


@job("three_way")
def three_way(df: DataFrame, key: str, context: Context) -> DataFrame:
    """-1 without a box behind the thoughts, 1 for a correct answer, -0.5 for a wrong one."""
    boxed = df.select(key, X.last_boxed(X.answer_part(F.col("response"))).alias("_box"))
    joined = deal(boxed, context["n_rows"], key).join(deal(verdicts(df, key, context), context["n_rows"], key), key)
    return joined.select(key, R.three_way_score(F.col("_box"), F.col("correct")).alias("value"))


@job("process")
def process(df: DataFrame, key: str, context: Context) -> DataFrame:
    """F1 of the labelled thoughts against the labelled lines of ``solution``; 0 where either has no line.

    One shuffle by key serves both texts and every aggregate.
    """
    def label(line: Column) -> Column:
        return eventlog.label_by_rules(line, LABEL_RULES, "Interpret Result")

    def edges(text: Column, reason: bool) -> Column:
        found = F.coalesce(eventlog.transition_array(F.coalesce(text, F.lit("")), label), F.array().cast("array<struct<src:string,dst:string>>"))
        return F.transform(found, lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit(reason).alias("reason")))

    both = F.concat(edges(X.thinking(F.col("response")), True), edges(F.col("solution"), False))
    # Rows without a key find no partner. An outer explode, as Spark would filter by the arrays first and so make them twice.
    rows = df.select(F.col(key).alias("case_id"), F.when(F.col(key).isNotNull(), both).alias("_edges"))
    opened = deal(rows, context["n_rows"], "case_id").select("case_id", F.explode_outer("_edges").alias("e"))
    counted = opened.where(F.col("e.src").isNotNull()).groupBy(
        "case_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(
        F.count_if("e.reason").alias("n_reason"), F.count_if(~F.col("e.reason")).alias("n_gold"))
    scores = conformance.score_edges(counted).select(F.col("case_id").alias(key), "f1")
    return deal(df.select(key), context["n_rows"], key).join(scores, key, "left").select(key, F.coalesce("f1", F.lit(0.0)).alias("value"))


@R.reward("similarity")
def similarity(df: DataFrame) -> Column:
    """1 when a number of the answer is one of the gold text, else the F1 of their tokens. Row-local."""
    answer, gold = F.coalesce(X.answer_part(df["response"]), F.lit("")), F.coalesce(df["gold"], F.lit(""))
    near = X.any_number_match(X.numbers(answer), X.numbers(gold))

    def f1(mine: Column, theirs: Column) -> Column:
        def times(items: Column, token: Column) -> Column:
            return F.size(F.filter(items, lambda x: x == token))

        common = F.aggregate(F.array_distinct(theirs), F.lit(0), lambda n, t: n + F.least(times(mine, t), times(theirs, t)))
        return token_f1(F.size(mine), F.size(theirs), common)

    score = X.let(X.tokens(answer), lambda a: X.let(X.tokens(gold), lambda b: f1(a, b)))
    return F.when(near, 1.0).otherwise(score)


def score(df: DataFrame, weights: dict[str, float], key: str = "id") -> DataFrame:
    """``key``, a column ``r_<name>`` for each reward of the list, and ``reward``, their weighted sum.

    Row-local rewards are columns of one pass; the others are jobs whose results are joined by ``key``, which must be
    unique. Grades are made once for all rewards that use them. A reward of weight 0 is computed and left out of the sum.
    """
    unknown = set(weights) - set(R.REWARDS) - set(JOBS)
    if unknown:
        raise ValueError(f"no such reward: {sorted(unknown)}")
    context: Context = {"n_rows": df.count()}
    out = df.select(key, *[R.REWARDS[name](df).alias(f"r_{name}") for name in weights if name in R.REWARDS])
    out = deal(out, context["n_rows"], key)
    for name in weights:
        if name in JOBS:
            out = out.join(JOBS[name](df, key, context).withColumnRenamed("value", f"r_{name}"), key)
    total = R.weighted_sum({f"r_{name}": weight for name, weight in weights.items()})
    return out.select(key, *[f"r_{name}" for name in weights], total.alias("reward"))
