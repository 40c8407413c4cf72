"""Votes over raw answers: classes under an equality that is not transitive.

The published rule goes through the answers in order: each joins the first class whose representative (its first
answer) equals it, else it opens a class. What an answer joins depends only on its text and on the classes opened
before it was first seen, so it is enough to go through the distinct texts of a group in the order they first came.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.functions import normalize as N
from veritrace.functions.answers import number, symbolic, words_only
from veritrace.functions.formulas import constant, read
from veritrace.operators.metrics import running_majority
from veritrace.operators.skew import join_back, key_counts
from veritrace.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Classes:
    """Representatives of one group. Values are looked up in sorted order, other answers are compared one by one."""

    def __init__(self):
        self.texts: list[str] = []
        self.places: dict[str, int] = {}
        self.values: list[tuple[float, int]] = []
        self.others: list[int] = []

    def place(self, text: str) -> int:
        """Number of the class that a normalised text joins; a new one if no representative equals it."""
        low = text.lower()
        if low in self.places:
            return self.places[low]
        value = number(text)
        if value is None and text and not words_only(text):
            tree = read(text)
            value = None if tree is None else constant(tree)
        equal = [i for i in (self._near(value) if value is not None else self.others) if symbolic(self.texts[i], text)]
        if equal:
            return min(equal)
        new = len(self.texts)
        self.texts.append(text)
        self.places[low] = new
        if value is None:
            self.others.append(new)
        else:
            bisect.insort(self.values, (value, new))
        return new

    def _near(self, value: float) -> Iterator[int]:
        """Classes with a value within the widest tolerance of this one, or of it as a percentage."""
        for center in (value, value * 100, value / 100):
            width = 2e-3 * abs(center) + 2e-8
            start = bisect.bisect_left(self.values, (center - width, -1))
            for _, place in self.values[start:bisect.bisect_right(self.values, (center + width, len(self.texts)))]:
                yield place


def answer_classes(df: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """keys, answer, class, votes, first_pos: the class of each distinct answer of a group, named by its first raw text.

    Answers are counted by partial aggregation and normalised once each over all groups. A group's distinct normal forms
    then stream through one task, which holds the representatives only; a group with very many samples is small there
    unless its answers are all different. NULL answers count as empty; empty answers are one class.
    """
    raw = df.select(*keys, F.coalesce(F.col(answer), F.lit("")).alias(answer), position)
    counted = materialize(raw.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("first_pos")), "answer-votes")
    texts = key_counts(counted, [answer], "answers")
    normal = materialize(N.symbolic(texts.select(answer), answer, "_form").select(answer, F.coalesce("_form", F.lit("")).alias("_form")), "normal-forms")
    counted = materialize(join_back(counted, normal, [answer], texts), "counted-answers")
    forms = counted.groupBy(*keys, "_form").agg(F.min("first_pos").alias("_first"), F.min_by(answer, "first_pos").alias("_raw"))
    order = [*keys, "_first"]
    dealt = forms.repartition(*keys).sortWithinPartitions(*order)
    schema = dealt.select(*keys, "_form").schema

    def assign(batches):
        group = classes = None
        names: list[str] = []
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in (*keys, "_form", "_raw")], strict=True)
            out = []
            for *key, form, text in rows:
                if classes is None or key != group:
                    group, classes, names = key, Classes(), []
                place = classes.place(form)
                if place == len(names):
                    names.append(text)
                out.append(names[place])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (*keys, "_form")], pa.array(out, pa.string())], names=[*keys, "_form", "class"])

    assigned = dealt.mapInArrow(assign, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", class string")
    same = None
    for k in (*keys, "_form"):
        match = F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))
        same = match if same is None else same & match
    joined = counted.alias("_a").join(assigned.alias("_b"), same)
    return joined.select(*[F.col(f"_a.{c}").alias(c) for c in (*keys, answer)], "_b.class", "_a.votes", "_a.first_pos")


def class_vote(df: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """The largest class of each group by its first raw answer, and its votes; ties go to the class opened first.

    An empty winner yields to the best class that is not empty.
    """
    classes = answer_classes(df, keys, answer, position)
    counted = classes.groupBy(*keys, "class").agg(F.sum("votes").alias("votes"), F.min("first_pos").alias("first_pos"))
    rank = F.struct("votes", -F.col("first_pos"))
    filled = F.when(F.col("class") != "", rank)
    top = F.struct(F.col("class").alias(answer), "votes")
    winners = counted.groupBy(*keys).agg(
        F.max_by(top, rank).alias("_top"), F.max_by(top, filled).alias("_filled"), F.max(filled).alias("_any"))
    chosen = F.when((F.col(f"_top.{answer}") == "") & F.col("_any").isNotNull(), F.col("_filled")).otherwise(F.col("_top"))
    return winners.select(*keys, chosen.alias("_w")).select(*keys, f"_w.{answer}", "_w.votes")


def running_class_majority(df: DataFrame, keys: list[str], answer: str, position: str) -> DataFrame:
    """Majority class after each sample, as its first raw answer; rows with the same key and answer may be very many."""
    rows = df.select(*keys, position, F.coalesce(F.col(answer), F.lit("")).alias(answer))
    classes = answer_classes(rows, keys, answer, position).select(*keys, answer, "class")
    named = join_back(rows, classes, [*keys, answer], key_counts(rows, [*keys, answer], "group-answers"))
    return running_majority(named, keys, "class", position).select(*keys, position, "majority")
