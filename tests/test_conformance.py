"""Fitness, precision, F1 and alignment on hand-made logs and against the known means of the event table."""

import random

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from veritrace.operators import alignment, conformance as conf, eventlog as ev
from veritrace.plans import fixtures as fx

# The published example trace.
GOLDEN = [
    "Start Problem", "Formulate Strategy", "Recall Definition", "Perform Comparison", "Apply Known Formula",
    "Formulate Strategy", "Evaluate Limit or Integral", "Simplify Expression", "Justify Step", "Check Validity",
    "Conclude Final Result", "End Problem",
]


def log(spark, **cases):
    rows = [(case, i + 1, activity) for case, trace in cases.items() for i, activity in enumerate(trace)]
    return spark.createDataFrame(rows, "case_id string, step long, activity string")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_a_log_conforms_to_itself(spark):
    same = log(spark, golden=GOLDEN)
    row = conf.conformance(same, same).first()
    assert (row["fitness"], row["precision"], row["f1"]) == (1.0, 1.0, 1.0)


def test_metrics_by_hand(spark):
    # Model from ABAC: ▶A, AB, BA, AC, C■. Gold AC: ▶A, AC, C■ all replay; at A the model also allows B.
    row = conf.conformance(log(spark, c="ABAC"), log(spark, c="AC")).first()
    assert row["fitness"] == 1.0
    assert row["precision"] == pytest.approx((1 + 1 + 1) / (1 + 2 + 1))
    # Nothing in common but nothing enabled either: 0, not an error.
    row = conf.conformance(log(spark, c="A"), log(spark, c="B")).first()
    assert (row["fitness"], row["precision"], row["f1"]) == (0.0, 0.0, 0.0)


def test_unpaired_cases_are_left_out(spark):
    got = conf.conformance(log(spark, a="AB", b="AB"), log(spark, b="AB", c="AB")).collect()
    assert [r["case_id"] for r in got] == ["b"]


@pytest.mark.parametrize("max_rows", [2_000_000, 8])
def test_known_means(spark, max_rows):
    scores = conf.conformance_of_sides(fx.sides(spark, SF_DIR), fx.ORDER, max_rows)
    row = scores.agg(*[F.avg(F.round(c, 6)).alias(c) for c in ("fitness", "precision", "f1")]).first()
    assert [round(row[c], 4) for c in ("fitness", "precision", "f1")] == [0.6853, 0.7352, 0.7066]


@pytest.mark.parametrize("tile", [16_384, 5])
def test_alignment(spark, tile):
    rng = random.Random(3)
    pairs = {
        "hand": ("ABCBD", "BDCAB"), "same": ("AAA", "AAA"), "none": ("XYZ", "ABC"),
        **{f"r{i}": ("".join(rng.choices("ABCD", k=rng.randrange(1, 40))), "".join(rng.choices("ABCD", k=rng.randrange(1, 40)))) for i in range(25)},
    }
    both = log(spark, **{c: t for c, (t, _) in pairs.items()}).withColumn("side", F.lit("T")).unionByName(
        log(spark, **{c: r for c, (_, r) in pairs.items()}).withColumn("side", F.lit("R")))
    got = {r["case_id"]: (r["common"], r["align_fitness"]) for r in alignment.alignment_fitness(both, tile).collect()}
    for case, (t, r) in pairs.items():
        assert got[case][0] == lcs(t, r)
        assert got[case][1] == pytest.approx(2 * lcs(t, r) / (len(t) + len(r)))
    assert (got["hand"][0], got["same"][0], got["none"][0]) == (3, 3, 0)


def test_traces_continue_in_parts(spark):
    got = ev.traces(log(spark, c="ABCDE"), part_size=2).orderBy("part").collect()
    assert [r["trace"] for r in got] == [["A", "B"], ["C", "D"], ["E"]]


def test_variant_fingerprints_keep_order(spark):
    rows = ev.variants(log(spark, a="AB", b="BA", c="AB", d="ABA")).collect()
    assert sorted((r["first_case"], r["n_cases"]) for r in rows) == [("a", 2), ("b", 1), ("d", 1)]


def test_text_transitions_equal_the_window(spark):
    texts = spark.createDataFrame([(1, "x\n\ny\nx"), (2, " \n"), (3, "z")], "id long, text string")
    fast = ev.text_transitions(texts, "id", "text", lambda line: line)
    steps = ev.lines_to_steps(texts, "id", "text").select(F.col("id"), F.col("step_no").alias("step"), F.col("line").alias("activity"))
    slow = ev.directly_follows_rows(steps, ["id"], ["step"])
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert [r["step"] for r in ev.lines_to_steps(texts, "id", "text").where("id = 1").orderBy("step_no").collect()] == ["01", "02", "03"]


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="activity"):
        ev.require_columns(spark.range(1), "activity")
