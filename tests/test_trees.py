"""Formulas, answer trees, pairing, votes on raw answers, grading by profile, lookups with hot keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veritrace.functions import answers as A
from veritrace.functions import formulas as Fm
from veritrace.functions import normalize as N
from veritrace.operators import grading, scoring, skew, votes


def near(x, y):
    return abs(x - y) <= 1e-9 * max(1, abs(x), abs(y))


@pytest.mark.parametrize("a, b, equal", [
    ("(x+1)(x-1)", "x^2-1", True), ("2x", "x^2", False), (r"\frac12+\frac{1}{3}", r"\frac56", True), ("x_{12}+1", "1+x_12", True),
    (r"\sqrt[3]{27}", "3", True), (r"e^{x+y}", r"e^x*e^y", True), (r"\log_2 8", "3", True), ("|-3|", "3", True), ("4!", "24", True),
    (r"\frac{x^2-1}{x-1}", "x+1", True), (r"\sin 2x", r"2\sin x\cos x", True), (r"\pi r^2", r"r^2\pi", True), ("-x^2", "(-x)^2", False),
    ("2^{100}", "1267650600228229401496703205376", True), ("x-x+3", "3", True), ("1/0", "1", None), ("two words", "2", None),
    (r"2\frac{1}{2}", "2.5", None), ("((1", "1", None), ("", "1", None), ("(" * 100 + "1" + ")" * 100, "1", None),
    ("9" * 5000, "1", None), ("x" + "+x" * 300, "x", None), ("(a+b+c+d+f+g)^{60}", "1", False), ("2^{9^{9^9}}", "1", None),
    (r"-\infty", r"-\infty", True), (r"\infty", "5", False), ("3 4", "12", None), ("a/b/c", r"\frac{a}{bc}", True),
])
def test_formulas(a, b, equal):
    assert Fm.equal_formulas(a, b, near) is equal or (len(a) > 300 and equal is None)


def test_equations_are_compared_on_one_side():
    half = lambda c: abs(c) in (0.5, 1, 2)
    assert Fm.equal_equations("2x+3=7", "-2x-3=-7", half) and Fm.equal_equations("y=x+1", "2y-2x=2", half)
    assert not Fm.equal_equations("x=2", "y=2", half) and not Fm.equal_equations("x=2", "3x=6", half)
    assert Fm.equal_equations(r"\sqrt{x}=2", r"2\sqrt{x}=4", half) and Fm.equal_equations("x=", "x=1", half) is None


def test_pairing_finds_a_match_whenever_there_is_one():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 5)
        table = {(i, j): rng.choice([True, False, None]) for i in range(n) for j in range(n)}
        orders = list(itertools.permutations(range(n)))
        sure = any(all(table[i, p[i]] for i in range(n)) for p in orders)
        maybe = any(all(table[i, p[i]] is not False for i in range(n)) for p in orders)
        got = A.pairing(list(range(n)), list(range(n)), lambda i, j: table[i, j])
        assert got is (True if sure else None if maybe else False)
    assert A.pairing(["1"], ["1", "1"], lambda a, b: True) is False


def test_trees_follow_the_kinds_of_both_sides():
    assert A.multilingual("(1,(2,3))", "(1,(2,3.0))") and A.multilingual(r"{2,{1,3}}", "{{3,1},2}")
    assert A.multilingual(None, "1") is False and A.multilingual("", "") is True and A.multilingual("", "1") is False
    assert A.symbolic("1,2", "2,1") is False and A.symbolic("1,2", "2,1", sets=True) and A.symbolic("é", "é") is False
    assert A.olympiad("(0,1]", "(0,1)") is False and A.olympiad(r"1\pm2", "3,-1") and A.olympiad("x=2", "2")


def test_classes_equal_the_rule_answer_by_answer():
    rng = random.Random(7)
    pool = ["0.5", "1/2", r"\frac{1}{2}", "50", "", "x+1", "1+x", "x", "Monday", "1,2", "1,2.0", "2,1", "1e3"]
    pool += [str(1000 * (1 + k * 4e-10)) for k in range(12)] + [str(0.2 + k * 1e-4) for k in range(10)] + [str(20 + k * 1e-2) for k in range(10)]
    for _ in range(40):
        seen = [rng.choice(pool) for _ in range(60)]
        classes, plain = votes.Classes(), []
        for text in seen:
            joined = next((c for c in plain if c.lower() == text.lower() or A.symbolic(c, text)), None)
            if joined is None:
                plain.append(text)
                joined = text
            assert classes.texts[classes.place(text)].lower() == joined.lower()


def test_votes_on_raw_answers(spark):
    rows = [("a", 1, "0.5"), ("a", 2, "1/2"), ("a", 3, "2"), ("a", 4, None), ("b", 1, ""), ("b", 2, ""), ("b", 3, "x=3"),
            (None, 1, "7"), (None, 2, "7.0"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, pos int, answer string")
    got = {r.g: (r.answer, r.votes) for r in votes.class_vote(df, ["g"], "answer", "pos").collect()}
    assert got == {"a": ("0.5", 2), "b": ("x=3", 1), None: ("7", 2), "c": ("", 1)}
    running = votes.running_class_majority(df.where("g = 'a'"), ["g"], "answer", "pos").orderBy("pos").collect()
    assert [r.majority for r in running] == ["0.5"] * 4


def test_grading_by_profile_keeps_every_row(spark):
    rows = [
        (1, "default", r"\boxed{4}", "4"), (1, "default", r"\boxed{4}", "4"), (2, None, "The answer is: 1+2+3", "6"), (3, "odd", None, "1"),
        (4, "default", r"\boxed{1}", None), (5, "olympiad", r"<think>\boxed{9}</think>\boxed{x=2} \boxed{y=3}", "y=3,x=2"),
        (6, "multilingual", r"\boxed{(B)} or \boxed{(C)}", "B"), (7, "default", r"\boxed{" + "a b " * 2000 + "}", "1"),
        (8, "default", r"\boxed{5\oplus 2}", "7"), (None, "default", r"\boxed{3}", "4"),
    ]
    df = spark.createDataFrame(rows, "id int, p string, response string, gold string")
    got = sorted(((r.id, r.judge, r.correct, r.undecided) for r in grading.grade(df, ["id"], profile=F.col("p")).collect()), key=str)
    assert got == sorted([
        (1, "boxed", True, None), (1, "boxed", True, None), (2, "pattern", True, None), (3, None, False, None), (4, None, False, None),
        (5, "olympiad", True, None), (6, "multilingual", True, None), (7, None, False, "length"), (8, None, False, "boxed"),
        (None, None, False, None)], key=str)


def test_hot_keys_are_dealt_and_joined_once(spark):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 400).cast("string")).alias("k"))
    table = df.select("k").distinct().withColumn("v", F.coalesce(F.concat(F.lit("v"), "k"), F.lit("none")))
    counts = skew.key_counts(df, ["k"])
    assert [(r["_key"]["k"], r["_deals"]) for r in skew.hot_keys(counts, ["k"], hot_rows=300).collect()] == [("hot", 7)]
    for limit in (300, 10**6):
        got = skew.join_back(df, table, ["k"], counts, hot_rows=limit)
        assert got.columns == ["id", "k", "v"] and got.count() == 6000
        assert got.where(F.col("v") != F.coalesce(F.concat(F.lit("v"), "k"), F.lit("none"))).count() == 0


def test_number_words(spark):
    cases = {"hundred " * 9 + "hundred": None, "one two three": None, "two point five": "2.5", "Ninety-Nine": "99", "hundred": "100",
             "three hundred and six": "306", "one billion and one": "1000000001", "twenty thirty": None, "point five": None,
             "nine hundred ninety nine billion nine hundred ninety nine million": "999999000000", "six apples": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    bad = df.withColumn("got", N.word_number(F.col("t"))).where(~F.col("got").eqNullSafe(F.coalesce("want", "t"))).collect()
    assert bad == []


def test_rewards_by_name(spark):
    rows = [(1, "<think>the plan\nhence</think>\\boxed{4}", "4", "the plan\nhence"), (2, "<think>the sum</think>about 5 apples", "4 apples", "we check"),
            (3, None, "4", None), (4, "no tags \\boxed{4}", "4", "")]
    df = spark.createDataFrame(rows, "id int, response string, gold string, solution string")
    got = {r.id: r for r in scoring.score(df, {"accuracy": 1, "three_way": 0.5, "similarity": 1, "process": 1, "format": 0}).collect()}
    assert [(got[i].r_accuracy, got[i].r_three_way) for i in (1, 2, 3, 4)] == [(1, 1), (0, -1), (0, -1), (1, -1)]
    assert got[1].r_similarity == 1 and round(got[2].r_similarity, 6) == round(2 * 1 / 5, 6) and got[4].r_similarity == 0
    assert got[1].r_process == 1 and got[2].r_process < 1 and got[3].r_process == 0
    assert got[1].reward == 3.5
    with pytest.raises(ValueError):
        scoring.score(df, {"nothing": 1})
