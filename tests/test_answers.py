"""Micro cases with hand-worked results for the text and answer functions."""

import pytest
from pyspark.sql import functions as F

from veritrace.functions import compare as C
from veritrace.functions import normalize as N
from veritrace.functions import rewards as R
from veritrace.functions import text as X
from veritrace.operators import grading, joins


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    (r"so \boxed{\frac{1}{2}} ok", r"\frac{1}{2}"), (r"\boxed{a} then \boxed{b{c}d}", "b{c}d"), (r"\boxed{open", None),
    ("no box", None), (r"\boxed {a}", None), (r"\boxed{}", ""),
])
def test_last_boxed(spark, text, want):
    assert one(spark, text, X.last_boxed) == want


def test_long_text_is_read_whole(spark):
    text = "x{}" * 20_000 + r"\boxed{" + "{a}" * 5_000 + "}"
    assert one(spark, text, X.last_boxed) == "{a}" * 5_000


def test_index_tag(spark):
    df = spark.createDataFrame([("42 <index>7</index>",)], "v string")
    solution, index = X.unpack_index(F.col("v"))
    assert tuple(df.select(solution, index).first()) == ("42", "7")


def test_spans(spark):
    got = one(spark, "<p>a</p>x<p>b\nc</p><p>d", lambda c: X.spans(c, "<p>", "</p>"))
    assert [tuple(s) for s in got] == [(0, 8), (9, 19)]
    assert [tuple(s) for s in one(spark, "<p>a</p>x<p>b</p>", lambda c: X.spans(c, "<p>", "</p>", greedy=True))] == [(0, 17)]


def test_overlaps_match_brute_force(spark):
    import random
    rng = random.Random(1)
    sides = [[(k, b, b + rng.randrange(1, 60)) for k in ("p", "q") for b in rng.sample(range(300), 25)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "k string, begin int, end int") for s in sides]
    got = joins.overlaps(*frames, "k", width=16).collect()
    want = [(k, b, e, c, f) for k, b, e in sides[0] for j, c, f in sides[1] if j == k and b < f and c < e]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("steps, cases", [
    (N.STRING, [r"\frac{1}{2}", "7+3/4", "1234", "(1,2)", r"\sqrt{3}", "x,y"]),
    (N.STRIP, [r"\frac{1}{2}", "1234", "(1,2)", r"\sqrt{3}", r"-\infty"]),
    (N.MATHD, [r"\frac{1}{2}", "1234", "(1,2)", r"\sqrt{3}"]),
    (N.GRADE, ["1234", "(1,2)", "7+3/4", "sqrt(3)"]),
])
def test_canonical_texts_stay_as_they_are(spark, steps, cases):
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert [r["out"] for r in N.run(df, "v", "out", steps).collect()] == cases


def test_mixed_number(spark):
    assert one(spark, "7 3/4", C.mixed_to_sum) == "7+3/4"


def test_nulls_do_not_become_answers(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, None)], "pred string, gold string")
    for judge in (grading.judge_string, grading.judge_grade, grading.judge_olympiad):
        assert [r["correct"] for r in judge(df).collect()] == [False, False, False]


@pytest.mark.parametrize("pred, gold, want", [
    ("1", "1,2", False), (r"\boxed{2,1}", "1,2", True), (r"1\pm2", "-1,3", True), ("0.5", "50", True), ("(0,1]", "(0,1]", True),
    ("[0,1]", "(0,1]", False), (r"(0,\frac{1}{2})", "(0,0.5)", True),
])
def test_olympiad_judge(spark, pred, gold, want):
    df = spark.createDataFrame([(pred, gold)], "pred string, gold string")
    assert grading.judge_olympiad(df).first()["correct"] is want


@pytest.mark.parametrize("pred, gold, want", [
    ("1,234", "1234", True), (r"\frac{2}{4}", "0.5", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "(2,1)", False),
    ("50%", "0.5", True), ("3.00001", "3", True), ("3.1", "3", False), ("YES", "yes", True), (r"2\sqrt{2}", "2.8284271", True),
    ("[1,2]", "(1,2)", False), ("", "1", False),
])
def test_string_judge(spark, pred, gold, want):
    df = spark.createDataFrame([(pred, gold)], "pred string, gold string")
    assert grading.judge_string(df).first()["correct"] is want


def test_cascade_stops_at_the_first_judge(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "B"), ("c", "d"), ("a", "a")], "pred string, gold string")
    exact = lambda d: d.withColumn("correct", F.col("pred") == F.col("gold"))
    folded = lambda d: d.withColumn("correct", F.lower("pred") == F.lower("gold"))
    got = grading.cascade(df, ["pred", "gold"], [("exact", exact), ("folded", folded)]).collect()
    assert sorted((r["pred"], r["judge"], r["correct"]) for r in got) == [("a", "exact", True), ("b", "folded", True), ("c", None, False)]


def test_reward_registry(spark):
    df = spark.createDataFrame([(r"<think>a</think>\boxed{1}",), (r"\boxed{1}\boxed{2}",)], "response string")
    got = R.with_rewards(df, ["format", "single_box"]).withColumn("r", R.weighted_sum({"r_format": 0.5, "r_single_box": 2, "x": 0}))
    assert [r["r"] for r in got.collect()] == [2.5, 0.0]


def test_token_f1_edges(spark):
    golds = spark.createDataFrame([(1, "a b b."), (2, ""), (3, "x")], "gold_id long, text string")
    preds = spark.createDataFrame([(1, 1, "B, a c"), (2, 2, "?!"), (3, 3, ""), (4, 1, "z")], "pred_id long, gold_id long, text string")
    got = {r["pred_id"]: r["f1"] for r in joins.token_overlap(preds, golds).collect()}
    assert got == {1: pytest.approx(4 / 6), 2: 1.0, 3: 0.0, 4: 0.0}


def test_json_score(spark):
    cases = ['{"score": 0.4}', '{"score": 7}', '{"score"', '{"reason": "x"}', '{"score": "0.5"}']
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert [r[0] for r in df.select(R.json_score(F.col("v"))).collect()] == [0.4, 1.0, 0.0, 0.0, 0.5]


def test_default_labels_are_in_the_vocabulary(spark):
    from veritrace.functions.rules import LABEL_RULES
    from veritrace.operators.eventlog import label_by_rules
    from veritrace.schemas import ACTIVITIES

    assert {label for _, label in LABEL_RULES} == set(ACTIVITIES)
    got = one(spark, "Therefore the answer is 4.", lambda c: label_by_rules(c, LABEL_RULES, "Interpret Result"))
    assert got == "Conclude Final Result"


def test_plain_texts_meet_few_replacements(spark):
    """Replacements that need a mark run behind a look for their marks: a plain number meets only a few one by one."""
    for profile in (N.STRING, N.STRIP, N.MATHD, N.GRADE, N.SYMBOLIC):
        assert sum(not callable(step) for step in profile) <= 20
    steps = [N.lit(r"\left"), N.lit("$"), N.lit("and", ","), N.lit(" .", " 0."), N.lit("{.", "{0."), N.lit("∞", "inf")]
    texts = ["12", "", None, r"\left(1", "$5", "1 and 2", "a .5", "{.5}", "{5}", "2∞", "ad", ". ", "\\", "a\n$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = N.run(N.run(df, "t", "guarded", [N.literals(steps)]), "t", "plain", steps).collect()
    assert [r["guarded"] for r in rows] == [r["plain"] for r in rows]


def test_closing_length_with_and_without_inner_braces(spark):
    """The end of a box is found the same way where it holds braces, none, or never closes."""
    texts = ["a}", "}", "a}b{", "{}}", "a{b}c}d", "{", "", "abc", "a{b}", "é}x", "{{}}}}", None]

    def by_hand(text):
        depth = 1
        for i, c in enumerate(text or ""):
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return i + 1
        return None if text is None else 0

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.closing_length(F.col("t"))).collect()] == [by_hand(t) for t in texts]
