"""What a task, a Python worker or a batch holds must not grow with the table."""

from pyspark.sql import Row
from pyspark.sql import types as T

from veritrace import session
from veritrace.operators import joins, language, scoring
from veritrace.streaming import jobs


def test_rewards_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    df = spark.range(400).selectExpr(
        "id", "concat('<think>the plan ', id, '\nhence</think>\\\\boxed{4}') as response", "'4' as gold", "if(id % 2 = 0, 'the plan\nhence', 'we check') as solution")
    value = scoring.JOBS["process"](df, "id", {"n_rows": 400})
    assert value.rdd.getNumPartitions() >= 40
    assert value.where((value.value == 1) != (value.id % 2 == 0)).count() == 0
    both = scoring.score(df, {"accuracy": 1, "process": 1})
    assert both.rdd.getNumPartitions() >= 40 and both.where("r_accuracy = 1").count() == 400


def test_shared_tokens_reach_python_row_by_row(spark):
    preds = spark.createDataFrame([(1, 7, "a b b c"), (2, 7, None), (3, 9, "x"), (4, 8, "B, b; z")], "pred_id long, gold_id long, text string")
    golds = spark.createDataFrame([(7, "b B c d"), (8, "b")], "gold_id long, text string")
    found = joins.shared_tokens(preds, golds)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {r.pred_id: sorted(map(tuple, r.shared)) for r in found.collect()} == {1: [("b", 2), ("c", 1)], 2: [], 3: [], 4: [("b", 1)]}


def test_trigrams_are_counted_in_the_text(spark, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 5)
    texts = spark.createDataFrame([(1, "en", "aAaaa"), (1, "en", "aaab"), (None, "en", None), (2, "de", "😀x😀x😀"), (3, "de", "ab")], "id int, lang string, text string")

    def code(gram):
        return sum(ord(c) << (42 - 21 * i) for i, c in enumerate(gram))

    rows = sorted((r.id, r.gram, r.n) for r in language.text_grams(texts, "id", "text").collect())
    assert rows == sorted([(1, code("aaa"), 3), (1, code("aaa"), 1), (1, code("aab"), 1), (2, code("😀x😀"), 2), (2, code("x😀x"), 1)])


class _Kept:
    """A value state, and the handle that gives it."""

    value = None

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_state_by_case_works_on_rows():
    kind, kept = T.StructType([T.StructField("_ts", T.LongType()), T.StructField("_event_id", T.LongType())]), _Kept()
    state = jobs._CaseEdges(kind, None)
    state.init(kept)

    def feed(*events):
        rows = iter([Row(activity=a, _ts=ts, _event_id=i, _at=[str(ts), str(i)]) for a, ts, i in events])
        return [(r.kind, r.src, r.dst, r.cnt, r.activity, r["at"]) for r in state.handleInputRows(("x",), rows, None)]

    assert feed(("B", 5, 2), ("A", 5, 1), ("B", 6, 3)) == [
        ("edge", "▶", "A", 1, None, None), ("edge", "A", "B", 1, None, None), ("edge", "B", "B", 1, None, None)]
    assert feed(("C", 4, 9), ("D", 6, 4), ("E", None, 5)) == [
        ("edge", "B", "D", 1, None, None), ("late", None, None, 1, "C", ["4", "9"]), ("late", None, None, 1, "E", ["None", "5"])]
    assert kept.value == (6, 4, "D")
