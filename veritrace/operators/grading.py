"""Grading jobs: distinct pairs are graded once, cheap judges run before dear ones."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import compare as C
from veritrace.functions import normalize as N
from veritrace.functions import text as X
from veritrace.functions.answers import formula_equal, multilingual_equal, olympiad_equal, symbolic_equal
from veritrace.operators.skew import join_back, key_counts, total_rows
from veritrace.session import deal, materialize

Judge = Callable[[DataFrame], DataFrame]


def on_distinct_pairs(df: DataFrame, columns: list[str], judge: Judge) -> DataFrame:
    """Run ``judge`` over the distinct values of ``columns`` and join its verdict back, NULLs included.

    The counts that make the values distinct also tell which of them are hot; their rows are dealt over tasks.
    """
    counts = key_counts(df, columns, "distinct-pairs")
    verdicts = judge(counts.select(*columns)).select(*columns, "correct")
    return join_back(df, verdicts, columns, counts)


def judge_string(df: DataFrame, pred: str = "pred", gold: str = "gold", *, open_ended: bool = False) -> DataFrame:
    """The "string" profile: canonical text, then number with tolerance, then closed form or tuple.

    Every stage is a column of its own and the dear ones run only for pairs the cheap ones left open. With ``open_ended``
    what is neither text, number, closed form nor tuple is compared as a formula, and NULL where it is none either.
    """
    df = df.withColumns({"_p": N.strip_currency(F.col(pred)), "_g": N.strip_currency(F.col(gold))})
    df = N.run(N.run(df, "_p", "_p", [*N.STRING, C.interval_brackets]), "_g", "_g", [*N.STRING, C.interval_brackets])
    p, g, pn, gn = (F.col(c) for c in ("_p", "_g", "_pn", "_gn"))
    df = df.withColumns({"_pn": C.parse_number(p, percent=False), "_gn": C.parse_number(g, percent=False)})
    same = F.lower(X.strip(p)) == F.lower(X.strip(g))
    numeric = pn.isNotNull() & gn.isNotNull()
    df = df.withColumn("_quick", F.when(same, True).when(numeric, C.numeric_equal(pn, gn, "string")).when(p == "", False))
    still_open = F.col("_quick").isNull()
    df = df.withColumns({"_pv": F.when(still_open, C.closed_value(p)), "_gv": F.when(still_open, C.closed_value(g))})
    valued = F.col("_pv").isNotNull() & F.col("_gv").isNotNull()
    slow = (
        F.when(C.numeric_equal(F.col("_pv"), F.col("_gv"), "string"), True)
        .when(_bare(p) == _bare(g), True)
        .when(_one_sided(p, g) & (_bare(_unbracketed(p)) == _bare(_unbracketed(g))), True)
        .when(_comparable_tuples(p, g), _tuple_equal(p, g, open_ended))
        .when(F.lit(not open_ended) | valued, False)
    )
    both = p.isNotNull() & g.isNotNull()
    df = df.withColumn("_known", F.coalesce("_quick", F.when(both, slow)))
    if open_ended:
        left_open = F.col("_known").isNull() & both
        df = df.withColumn("_formula", formula_equal(F.when(left_open, p), F.when(left_open, g)))
        verdict = F.coalesce("_known", "_formula", F.when(~both, False))
    else:
        verdict = F.coalesce("_known", F.lit(False))
    return df.withColumn("correct", verdict).drop("_p", "_g", "_pn", "_gn", "_quick", "_pv", "_gv", "_known", "_formula")


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[{}()]", "")


def _one_sided(p: Column, g: Column) -> Column:
    """The prediction is in brackets of a kind that the gold answer does not contradict."""
    return (p.rlike(r"(?s)^\[.*\]$") & ~g.startswith("(")) | (p.rlike(r"(?s)^\(.*\)$") & ~g.startswith("["))


def _unbracketed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\[\]()]+|[\[\]()]+$", "")


def _comparable_tuples(p: Column, g: Column) -> Column:
    """Both are lists, and when both are bracketed the brackets agree."""
    brackets = (F.left(p, F.lit(1)) == F.left(g, F.lit(1))) & (F.right(p, F.lit(1)) == F.right(g, F.lit(1)))
    bracketed = p.rlike(r"^[\[(].*[\])]$") & g.rlike(r"^[\[(].*[\])]$")
    return p.contains(",") & g.contains(",") & (~bracketed | brackets)


def _tuple_equal(p: Column, g: Column, open_ended: bool) -> Column:
    """Elements agree position by position, as text or by value; NULL where one has no value and that is asked for."""
    def parts(s: Column) -> Column:
        inner = F.split(F.regexp_replace(s, r"^[\[(](.*)[\])]$", "$1"), ",", -1)
        return F.transform(inner, lambda e: F.struct(F.lower(X.strip(e)).alias("text"), C.closed_form(e).alias("value")))

    def same(a: Column, b: Column) -> Column:
        return F.when(a["text"] == b["text"], True).otherwise(C.numeric_equal(a["value"], b["value"], "string"))

    def decide(a: Column, b: Column) -> Column:
        differ = F.exists(F.zip_with(a, b, same), lambda ok: ~ok)
        return F.when(F.size(a) != F.size(b), False).otherwise(F.when(differ, False).otherwise(
            F.forall(F.zip_with(a, b, same), lambda ok: ok)))

    return X.let(parts(p), lambda a: X.let(parts(g), lambda b: decide(a, b))) if open_ended else C.all_pairs_equal(parts(p), parts(g), same)


def judge_grade(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """The "mathd + grade" profile."""
    for source, steps, target in ((pred, N.MATHD, "_pm"), (gold, N.MATHD, "_gm"), (pred, N.GRADE, "_pg"), (gold, N.GRADE, "_gg")):
        df = N.run(df, source, target, steps)
    verdict = C.grade_equal(F.col("_gm"), F.col("_pm"), F.col("_gg"), F.col("_pg"))
    return df.withColumn("correct", F.coalesce(verdict, F.lit(False))).drop("_pm", "_gm", "_pg", "_gg")


def judge_olympiad(df: DataFrame, pred: str = "pred", gold: str = "gold", *, extracted: bool = False) -> DataFrame:
    """The "olympiad" profile: symbol map, items between top-level commas, ± both ways, each paired with an equal one.

    Items are intervals, numbers, expressions or equations (both sides brought to one, a whole multiple of the other).
    With ``extracted`` the prediction holds items already, not a response.
    """
    df = N.run(N.run(df, pred, "_p", N.OLYMPIAD[1:] if extracted else N.OLYMPIAD), gold, "_g", N.OLYMPIAD)
    return _decided(df, lambda p, g: olympiad_equal(p, g))


def judge_multilingual(df: DataFrame, pred: str = "pred", gold: str = "gold", *, normalise: bool = True) -> DataFrame:
    """The "multilingual" profile: letter, percent-aware number, tuple, set, matrix, union, equation or formula."""
    if normalise:
        df = N.run(N.run(df, pred, "_p", N.multilingual()), gold, "_g", N.multilingual())
    else:
        df = df.withColumns({"_p": F.col(pred), "_g": F.col(gold)})
    return _decided(df, lambda p, g: multilingual_equal(p, g))


def judge_symbolic(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """The "symbolic" profile: dates and words first, then both sides by their kinds; two sets pair their members freely."""
    dates = {name: C.normalize_datetime(F.col(name)) for name in (pred, gold)}
    sets = N.is_set(X.strip(F.col(pred))) & N.is_set(X.strip(F.col(gold)))
    df = df.withColumns({"_same_time": F.coalesce(dates[pred] == dates[gold], F.lit(False)), "_sets": F.coalesce(sets, F.lit(False))})
    df = N.symbolic(N.symbolic(df, pred, "_p"), gold, "_g")
    df = _decided(df, lambda p, g: symbolic_equal(p, g, F.col("_sets")))
    return df.withColumn("correct", F.when(F.col("_same_time"), True).otherwise(F.col("correct"))).drop("_same_time", "_sets")


def _decided(df: DataFrame, compare: Callable[[Column, Column], Column]) -> DataFrame:
    """Equal texts are settled here; other pairs go to ``compare`` in Arrow batches. A missing side is not equal."""
    p, g = F.col("_p"), F.col("_g")
    quick = F.when(p.isNull() | g.isNull(), False).when(p == g, True)
    df = df.withColumn("_quick", quick)
    rest = F.col("_quick").isNull()
    df = df.withColumn("_slow", compare(F.when(rest, p), F.when(rest, g)))
    return df.withColumn("correct", F.coalesce("_quick", "_slow")).drop("_p", "_g", "_quick", "_slow")


# ------------------------------------------------------------------ grading by data set

@dataclass(frozen=True)
class Step:
    """A judge of a cascade: what it reads out of a response, and the entry of ``JUDGES`` that compares it with gold."""

    name: str
    extract: Callable[[Column], Column]
    by: str


def _behind_thoughts(text: Column) -> Column:
    return F.when(X.has(text, "</think>"), X.answer_part(text)).otherwise(text)


#: Judges that compare an extracted candidate (``pred``) with ``gold``; each accepts identical texts that are not empty.
JUDGES: dict[str, Judge] = {
    "string": lambda df: judge_string(df, open_ended=True),
    "symbolic": lambda df: judge_symbolic(df),
    "grade": lambda df: judge_grade(N.run(df, "pred", "pred", N.STRIP)),
    "olympiad": lambda df: judge_olympiad(df, extracted=True),
    "multilingual": lambda df: judge_multilingual(df, normalise=False),
}
_SHARED = [
    Step("boxed", X.last_boxed, "string"),
    Step("pattern", lambda t: X.by_pattern(t, "The answer is: (.+)$"), "string"),
    Step("symbolic", lambda t: F.try_element_at(X.all_boxed(t), F.lit(-1)), "symbolic"),
]
#: The judges of each profile, in order. Data sets name one of them; the last judge is the profile's own.
PROFILES: dict[str, list[Step]] = {
    "default": [*_SHARED, Step("grade", lambda t: X.tidy_extracted(X.cascade_raw(t)), "grade")],
    "olympiad": [*_SHARED, Step("olympiad", lambda t: N.olympiad_text(_behind_thoughts(t)), "olympiad")],
    "multilingual": [*_SHARED, Step("multilingual", lambda t: F.try_element_at(X.all_boxed(t), F.lit(1)), "multilingual")],
}
#: Longest text that is read as an answer. Longer ones equal no gold answer but their own text, and are undecided otherwise.
LONGEST_ANSWER = 4096


def grade(
    df: DataFrame, keys: list[str], *, response: str = "response", gold: str = "gold", profile: Column | str = "default",
    profiles: dict[str, list[Step]] | None = None, judges: dict[str, Judge] | None = None,
) -> DataFrame:
    """Grade responses, each by the cascade its ``profile`` names: keys, judge, correct, undecided.

    Every judge's candidate is read out of the response in one pass over the rows, so no response is shuffled. The
    distinct (profile, gold, candidates) are opened into pairs, each judge runs once over the distinct pairs it is asked
    for, and verdicts go back over two joins whose hot keys are dealt over tasks. ``judge`` is the first that accepts;
    ``undecided`` names the first that could not decide where none accepts. Judges behind a candidate that is the gold
    text itself are not asked.

    NULL responses and gold answers are not correct, and decided. A candidate beyond ``LONGEST_ANSWER`` characters is
    undecided ("length") unless it equals the gold answer. An unknown or NULL profile is graded by the first entry.
    """
    profiles, judges = profiles or PROFILES, {**JUDGES, **(judges or {})}
    chosen = profile if isinstance(profile, Column) else F.lit(profile)
    n_steps = max(len(p) for p in profiles.values())
    rows = df.select(*keys, F.when(chosen.isin(*profiles), chosen).otherwise(F.lit(next(iter(profiles)))).alias("_profile"),
                     F.col(gold).alias("_gold"), F.col(response).alias("_response"))

    def by_profile(pick: Callable[[Step], Column], i: int) -> Column:
        out = F.lit(None).cast("string")
        groups: dict[Step, list[str]] = {}
        for name, steps in profiles.items():
            if i < len(steps):
                groups.setdefault(steps[i], []).append(name)
        for step, names in groups.items():
            out = F.when(F.col("_profile").isin(*names), pick(step)).otherwise(out)
        return out

    names = [f"_c{i}" for i in range(n_steps)]
    read = rows.select(*keys, "_profile", "_gold", *[
        by_profile(lambda step: step.extract(F.col("_response")), i).alias(names[i]) for i in range(n_steps)])
    fits = {c: F.length(c) <= LONGEST_ANSWER for c in names}
    same = {c: F.coalesce(F.col(c) == F.col("_gold"), F.lit(False)) for c in names}
    long = F.array_contains(F.array(*[F.coalesce(~fits[c] & ~same[c], F.lit(False)) for c in names]), True)
    read = materialize(read.select(
        *keys, "_profile", "_gold", long.alias("_long"), *[F.when(fits[c] | same[c], F.col(c)).alias(c) for c in names]), "candidates")

    answer = ["_profile", "_gold", "_long", *names]
    answers = key_counts(read, answer, "distinct-answers")
    settled = F.array(*[F.coalesce((X.strip(F.col(c)) == X.strip(F.col("_gold"))) & (X.strip(F.col(c)) != ""), F.lit(False)) for c in names])
    last_asked = F.coalesce(F.nullif(F.array_position(settled, True), F.lit(0)), F.lit(n_steps)).cast("int")
    asked = F.array(*[
        F.struct(F.lit(i).alias("i"), by_profile(lambda step: F.lit(step.name), i).alias("judge"),
                 by_profile(lambda step: F.lit(step.by), i).alias("by"), F.col(names[i]).alias("pred"))
        for i in range(n_steps)])
    wanted = F.filter(F.slice(asked, F.lit(1), last_asked), lambda s: s["pred"].isNotNull() & F.col("_gold").isNotNull())
    opened = answers.select(F.struct(*answer).alias("_answer"), F.col("_gold").alias("gold"), F.explode(wanted).alias("s"))
    opened = materialize(opened.select("_answer", "gold", "s.i", "s.judge", "s.by", "s.pred"), "asked")

    pair = ["by", "pred", "gold"]
    pairs = key_counts(opened, pair, "distinct-pairs")

    def run(name: str) -> DataFrame:
        mine = judges[name](pairs.where(F.col("by") == name).select("gold", "pred", F.col("pred").alias("_pred")))
        return materialize(mine.select(F.lit(name).alias("by"), F.col("_pred").alias("pred"), "gold", "correct"), f"judged-{name}")

    wanted_judges = list(dict.fromkeys(step.by for steps in profiles.values() for step in steps))
    with ThreadPoolExecutor(len(wanted_judges)) as pool:  # they do not need each other: one plans while another runs
        judged = reduce(DataFrame.unionByName, pool.map(run, wanted_judges))
    told = deal(join_back(opened, judged, pair, pairs, by_rows=True), total_rows(pairs), "_answer").groupBy("_answer").agg(
        F.min_by("judge", F.when(F.col("correct"), F.col("i"))).alias("judge"),
        F.min_by("judge", F.when(F.col("correct").isNull(), F.col("i"))).alias("_open"))
    told = told.select(*[F.col(f"_answer.{c}").alias(c) for c in answer], "judge", "_open")
    done = join_back(read, told, answer, answers, by_rows=True)
    unknown = F.when(F.col("judge").isNull(), F.coalesce(F.when(F.col("_long"), F.lit("length")), F.col("_open")))
    return done.select(*keys, "judge", F.col("judge").isNotNull().alias("correct"), unknown.alias("undecided"))


def cascade(pairs: DataFrame, columns: list[str], judges: list[tuple[str, Judge]]) -> DataFrame:
    """OR over judges in order; each judge sees only the distinct pairs that no earlier one accepted.

    Each stage is written once, so a judge never runs again for a later stage. Returns the distinct pairs with ``correct`` and the name of the accepting judge (NULL when none did).
    """
    open_pairs = pairs.select(*columns).distinct()
    accepted = None
    for name, judge in judges:
        judged = judge(open_pairs).withColumn("correct", F.coalesce("correct", F.lit(False)))
        judged = materialize(judged, f"judged-{name}")
        won = judged.where("correct").select(*columns, F.lit(name).alias("judge"))
        accepted = won if accepted is None else accepted.unionByName(won)
        open_pairs = judged.where(~F.col("correct")).select(*columns)
    lost = open_pairs.withColumn("judge", F.lit(None).cast("string"))
    return accepted.unionByName(lost).withColumn("correct", F.col("judge").isNotNull())
