"""Inputs beyond the shapes of the fixtures."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrace.functions import compare, normalize
from veritrace.operators import eventlog, grading, metrics
from veritrace.plans.fixtures import two_digits
from veritrace.sources import embedded_csv, files
from veritrace.streaming import jobs


def test_step_numbers_keep_all_digits(spark):
    rows = spark.createDataFrame([(1,), (10,), (100,), (12345,)], "n long").select(two_digits(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["01", "10", "100", "12345"]


def test_repeated_steps_do_not_merge_traces(spark):
    log = spark.createDataFrame(
        [("x", 1, "A"), ("x", 1, "A"), ("x", 2, "B"), ("y", 1, "C"), ("y", 1, "C"), ("y", 2, "B")], "case_id string, step int, activity string")
    assert eventlog.variant_keys(log).select("h1", "h2").distinct().count() == 2


def test_rows_without_a_group_keep_an_advantage(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0)], "g string, r double")
    assert metrics.group_advantage(df, "g", "r").count() == 4
    assert sorted(r.advantage for r in metrics.leave_one_out_advantage(df, "g", "r").collect()) == [-2.0, -2.0, 2.0, 2.0]


def one_column(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def normalized(spark, values, steps):
    out = normalize.run(one_column(spark, values), "t", "c", steps).collect()
    return {r.t: r.c for r in out}


def test_units_go_in_the_published_order(spark):
    once = normalized(spark, ["4 pi sq m", "5 sq . m", "a b c d e f g", "12 km"], [normalize._drop_units, normalize._drop_units])
    assert {k: v.strip() for k, v in once.items()} == {"4 pi sq m": "4 pi", "5 sq . m": "5  .", "a b c d e f g": "", "12 km": "12"}


def test_number_words_have_no_upper_end(spark):
    want = {
        "thirty": "30", "forty two": "42", "hundred": "100", "Ninety-nine": "99", "two hundred and five": "205", "zero": "zero",
        "three million four hundred thousand six": "3400006", "forty apples": "forty apples", "and": "and", "": "",
    }
    assert normalized(spark, list(want), [normalize.word_number]) == want


def test_commands_lose_their_braces_at_any_depth(spark):
    want = {
        r"\text{a{b{c{d{e}}}}}f": "a{b{c{d{e}}}}f", r"{\em x}+1": "x+1", r"\text{a": "{a", r"\text5": "5",
        r"{\em x": "{x", "plain": "plain", r"\text{a\text{b}}c": r"a\text{b}c",
    }
    assert r"\text" in normalize.rules.SYMBOLIC_COMMANDS
    out = one_column(spark, want)
    for name in (r"\text", r"\em"):
        out = out.withColumn("c", normalize._drop_command(F.coalesce(F.col("c"), F.col("t")) if "c" in out.columns else F.col("t"), F.lit(name)))
    assert {r.t: r.c for r in out.collect()} == want


def test_long_exponents_are_closed_forms(spark):
    rows = one_column(spark, ["1.001^1000", "10^9999", "2*1.001^{1000}", "3*10^-9999"]).select("t", compare.closed_form(F.col("t")).alias("v")).collect()
    values = {r.t: r.v for r in rows}
    assert abs(values["1.001^1000"] - 1.001**1000) < 1e-9 and abs(values["2*1.001^{1000}"] - 2 * 1.001**1000) < 1e-9
    assert values["10^9999"] is None and values["3*10^-9999"] == 0.0


def test_brackets_of_one_side_and_named_intervals(spark):
    cases = [
        ("[5]", "5", True), ("(5)", "5", True), ("[5]", "(6)", False), ("Interval(1, 2)", "[1,2]", True), ("Interval.open(1, 2)", "(1,2)", True),
        ("Interval.Lopen(1, 2)", "(1,2]", True), ("Interval.Ropen(1, 2)", "[1,2)", True), ("Interval.open(1, 2)", "[1,2]", False), ("[1,2]", "(1,2)", False),
    ]
    pairs = spark.createDataFrame(cases, "pred string, gold string, want boolean")
    assert [(r.pred, r.gold) for r in grading.judge_string(pairs).collect() if r.correct != r.want] == []


def test_rows_behind_the_state_are_late(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "case_id string, activity string, ts long, event_id long"
    batches = [[("x", "C", 3, 3), ("x", "A", 1, 1)], [("x", "B", 2, 2), ("y", "A", 1, 4)], [("x", "D", 3, 5), ("x", "D", 3, 5)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counts = jobs.run_keyed(jobs.keyed_dfg(jobs.read_files(spark, source, T._parse_datatype_string(schema)), ["ts", "event_id"]), out, checkpoint)
        assert counts.rows_in == 2
    found = spark.read.schema(jobs.EDGES).parquet(out)
    edges = {(r.src, r.dst): r.cnt for r in found.where("kind = 'edge'").groupBy("src", "dst").agg(F.sum("cnt").alias("cnt")).collect()}
    assert edges == {("▶", "A"): 2, ("A", "C"): 1, ("C", "D"): 1, ("D", "D"): 1}
    assert [(r.case_id, r.activity, r["at"]) for r in found.where("kind = 'late'").collect()] == [("x", "B", ["2", "2"])]


def test_a_case_without_events_is_forgotten(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = T._parse_datatype_string("case_id string, activity string, ts timestamp, event_id long")
    for day, rows in ((1, [("x", "A", 1), ("y", "A", 2)]), (9, [("y", "B", 3)]), (10, [("x", "B", 4), ("y", "C", 5)])):
        spark.createDataFrame([(c, a, datetime(2024, 1, day, 12, i), i) for c, a, i in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_files(spark, source, schema)
        jobs.run_keyed(jobs.keyed_dfg(stream, ["ts", "event_id"], gap="7 days"), out, checkpoint)
    edges = spark.read.schema(jobs.EDGES).parquet(out).where("kind = 'edge'").groupBy("src", "dst").agg(F.sum("cnt").alias("n")).collect()
    assert {(r.src, r.dst): r.n for r in edges} == {("▶", "A"): 2, ("A", "B"): 1, ("▶", "B"): 1, ("B", "C"): 1}


def test_length_percentiles_lie_within_the_stated_rank(spark):
    df = spark.range(40_000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 40_000).alias("len"), F.when(F.col("id") % 4 > 0, "stop").alias("why"))
    rows = {r.finish_reason: r for r in metrics.length_stats(df, "g", "len", "why", accuracy=200).collect()}
    assert {k: r.n for k, r in rows.items()} == {"stop": 30_000, "unknown": 10_000, "all": 40_000}
    for share, got in ((0.5, rows["all"].p50), (0.9, rows["all"].p90), (0.99, rows["all"].p99)):
        assert abs(got - share * 40_000) <= 40_000 / 200 + 1


def test_whole_numbers_beyond_38_digits_stay_numbers(spark):
    big = "1" + "0" * 45
    pairs = spark.createDataFrame([(big, "1e45", True), (big, big, True), (big, big + "0", False), ("1e999", "5", False)], "pred string, gold string, want boolean")
    assert [(r.pred, r.gold) for r in grading.judge_grade(pairs).collect() if r.correct != r.want] == []
    assert {r.c for r in one_column(spark, [big, "1e45"]).select(normalize.whole(F.col("t")).alias("c")).collect()} == {big}


def test_a_key_without_a_header_is_rejected_once(spark):
    texts = spark.createDataFrame([(1, "no log here"), (1, "nor here"), (2, "nothing")], "k int, t string")
    assert sorted((r.k, r.line_no) for r in embedded_csv.rejects(texts, "k", "t").collect()) == [(1, -1), (2, -1)]


def test_compaction_sizes_its_files(spark, tmp_path):
    small, out = str(tmp_path / "small"), str(tmp_path / "out")
    df = spark.range(50_000).repartition(8)
    df.write.parquet(small)
    files.compact(spark, small, df.schema, out, file_bytes=100_000)
    assert 1 < len(list((tmp_path / "out").glob("*.parquet"))) <= 8
    assert spark.read.parquet(out).count() == 50_000
