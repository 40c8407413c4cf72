"""Explicit schemas and the closed activity vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

#: One line of an event log embedded in text. Every field is read as text; typing is a later step.
CSV_EVENT = "case_id STRING, step STRING, activity STRING, description STRING"

PROBLEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("final_answer", T.StringType()),
    T.StructField("r1_solution_1", T.StringType()),
])

# Header of an embedded event log.
CSV_HEADER = ["Case ID", "Step", "Activity", "Description"]

# The closed activity vocabulary, in its published order.
ACTIVITIES = [
    "Start Problem",
    "Recall Definition",
    "Identify Known Results",
    "Formulate Strategy",
    "Apply Known Formula",
    "Simplify Expression",
    "Change of Variable",
    "Evaluate Limit or Integral",
    "Perform Comparison",
    "Apply Theorem",
    "Justify Step",
    "Explore Edge Cases",
    "Identify Contradiction",
    "Interpret Result",
    "Check Validity",
    "Verify With Example",
    "Refine or Change Strategy",
    "Conclude Final Result",
    "Recheck Original Question",
    "End Problem",
]

# Artificial nodes that mark where a trace starts and ends.
START, END = "▶", "■"
