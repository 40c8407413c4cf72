import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrace.operators import language, metrics as M


@pytest.mark.parametrize("n, c, k, want", [
    (20, 5, 1, 0.25), (20, 5, 2, 0.447368), (20, 5, 4, 0.718266), (4, 4, 4, 1.0), (8, 0, 1, 0.0),
])
def test_pass_at_k(spark, n, c, k, want):
    got = spark.range(1).select(M.pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-6)


def test_pass_at_k_grows_with_k(spark):
    counts = spark.createDataFrame([(i, 32, i) for i in range(33)], "id long, n long, c long")
    rows = M.pass_at_all_k(counts).orderBy("id", "k").collect()
    for a, b in zip(rows, rows[1:]):
        if a["id"] == b["id"]:
            assert a["pass_at_k"] <= b["pass_at_k"] + 1e-12
    assert all(r["pass_at_k"] == pytest.approx(r["c"] / r["n"]) for r in rows if r["k"] == 1)


def majority(answers):
    """Plain reading of the rule: counts with first-seen ties, an empty winner yields to the runner-up."""
    ranked = Counter(answers).most_common(2)
    return ranked[1][0] if ranked[0][0] == "" and len(ranked) > 1 else ranked[0][0]


@pytest.mark.parametrize("max_rows", [100_000, 9])
def test_running_majority(spark, max_rows):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", i, rng.choice(["", "", "1", "2", "x"])) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, pos long, answer string")
    got = {r["pos"]: r["majority"] for r in M.running_majority(df, ["g"], "answer", "pos", max_rows).collect()}
    seen = {}
    for group, pos, answer in rows:
        seen.setdefault(group, []).append(answer)
        assert got[pos] == majority(seen[group])


def test_votes(spark):
    df = spark.createDataFrame(
        [("a", 1, ""), ("a", 2, ""), ("a", 3, "7"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "")],
        "g string, pos int, answer string")
    assert sorted(tuple(r) for r in M.equivalence_vote(df, ["g"], "answer", "pos").collect()) == [("a", "7", 1), ("b", "x", 1), ("c", "", 1)]
    assert sorted(tuple(r) for r in M.most_common(df, ["g"], "answer", "pos").collect()) == [("a", "", 2), ("b", "x", 1), ("c", "", 1)]


def test_level_score(spark):
    rows = [("en", level, acc) for level, acc in zip(("low", "middle", "high", "top"), (80.0, 60.0, 40.0, 20.0))]
    df = spark.createDataFrame(rows + [("de", "low", 90.0)], "language string, level string, accuracy double")
    got = {r["language"]: r["weighted_score"] for r in M.weighted_level_score(df).collect()}
    assert round(got["en"], 1) == 34.7 and got["de"] is None


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5)], "g string, r double")
    loo = sorted((r["g"], r["advantage"]) for r in M.leave_one_out_advantage(df, "g", "r").where("g = 'a'").collect())
    assert loo == [("a", -1.0), ("a", 1.0)]
    assert M.leave_one_out_advantage(df, "g", "r").where("g = 'b'").first()["advantage"] is None


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "o long, v long")
    got = {r["o"]: r["t"] for r in M.running_total(df, "o", "v", "t", width=7).collect()}
    assert all(got[i] == sum(j % 5 for j in range(i + 1)) for i in range(50))


def test_language_detection(spark):
    texts = spark.createDataFrame(
        [(i, "en", "the quick brown fox and the dog") for i in range(5)]
        + [(i + 5, "de", "der schnelle braune fuchs und der hund") for i in range(5)]
        + [(10, "en", "und der fuchs und der hund"), (11, "de", "kurz")], "id long, lang string, text string")
    got = {r["lang"]: (r["n"], r["percent_consistent"]) for r in language.consistency(texts, "id", "lang", "text").collect()}
    assert got["de"] == (6, 100.0) and got["en"] == (6, pytest.approx(83.3))
