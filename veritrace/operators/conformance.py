"""Fitness, escaping-edge precision and F1 of one log against the model learned from another, per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.eventlog import directly_follows_rows
from veritrace.operators.ordering import MAX_ROWS_PER_TASK, KeySkew, per_key

REASON, GOLD = "R", "T"


def paired_edges(
    both: DataFrame, order: list[str], max_rows: int = MAX_ROWS_PER_TASK, case: str = "case_id",
    skew: KeySkew | None = None,
) -> DataFrame:
    """Edge table with the count of every edge in either log. ``both`` carries ``side`` (R or T).

    The two logs are ordered in one pass and aggregated into one row per (case, edge), so fitness and
    precision need no join: membership of an edge in the other log is a column. Without a hot case the one
    shuffle by case serves the ordering and every aggregate after it.
    """
    rows = directly_follows_rows(both.select(case, "side", "activity", *[c for c in order if c != "activity"]),
                                 [case, "side"], order, max_rows, co_locate=[case], skew=skew)
    is_reason = F.col("side") == REASON
    return rows.groupBy(case, "src", "dst").agg(
        F.count_if(is_reason).alias("n_reason"), F.count_if(~is_reason).alias("n_gold")
    )


def edge_metrics(edges: DataFrame, case: str = "case_id") -> DataFrame:
    """Replay fitness and escaping-edge precision per case from the paired edge table."""
    per_state = edges.groupBy(case, "src").agg(
        F.sum("n_gold").alias("visits"),
        F.sum(F.when(F.col("n_reason") > 0, F.col("n_gold")).otherwise(0)).alias("replayed"),
        F.count_if(F.col("n_reason") > 0).alias("enabled"),
        F.count_if((F.col("n_reason") > 0) & (F.col("n_gold") > 0)).alias("used"),
        F.sum("n_reason").alias("reason_edges"),
    )
    per_case = per_state.groupBy(case).agg(
        F.sum("visits").alias("transitions"),
        F.sum("reason_edges").alias("reason_transitions"),
        (F.sum("replayed") / F.nullif(F.sum("visits"), F.lit(0))).alias("fitness"),
        F.coalesce(
            F.sum(F.col("visits") * F.col("used"))
            / F.nullif(F.sum(F.col("visits") * F.col("enabled")), F.lit(0)),
            F.lit(0.0),
        ).alias("precision"),
    )
    return per_case


def f1(fitness: Column, precision: Column) -> Column:
    """Harmonic mean, 0 when both are 0."""
    return F.when(fitness + precision > 0, 2 * fitness * precision / (fitness + precision)).otherwise(F.lit(0.0))


def conformance(
    reason_log: DataFrame, gold_log: DataFrame, order: list[str] = ("step",), max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Fitness, precision and F1 for every case present in both logs."""
    columns = ["case_id", "activity", *[c for c in order if c != "activity"]]
    both = reason_log.select(*columns, F.lit(REASON).alias("side")).unionByName(
        gold_log.select(*columns, F.lit(GOLD).alias("side"))
    )
    return conformance_of_sides(both, list(order), max_rows)


def conformance_of_sides(both: DataFrame, order: list[str], max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """As :func:`conformance` for a single table that already carries ``side``."""
    return per_key(
        both, ["case_id"], max_rows, lambda part, skew: score_edges(paired_edges(part, order, max_rows, skew=skew))
    )


def score_edges(edges: DataFrame) -> DataFrame:
    """Metrics of the cases that have transitions in both logs."""
    per_case = edge_metrics(edges)
    return per_case.where((F.col("transitions") > 0) & (F.col("reason_transitions") > 0)).select(
        "case_id", "fitness", "precision", f1(F.col("fitness"), F.col("precision")).alias("f1")
    )


def log_level_conformance(
    train_edges: DataFrame, test_log: DataFrame, order: list[str], max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Each test case against one model learned from many cases.

    The model has at most |activities|^2 edges; it is joined on the edge, never paired with all cases.
    """
    per_case = (
        directly_follows_rows(test_log, ["case_id"], order, max_rows)
        .groupBy("case_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_gold"))
    )
    known = train_edges.select("src", "dst", F.lit(1).alias("known"))
    enabled = train_edges.groupBy("src").agg(F.count(F.lit(1)).alias("enabled"))
    scored = per_case.join(known, ["src", "dst"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    per_state = scored.groupBy("case_id", "src").agg(
        F.sum("n_gold").alias("visits"),
        F.sum(F.col("n_gold") * F.col("known")).alias("replayed"),
        F.sum("known").alias("used"),
    ).join(enabled, "src", "left").withColumn("enabled", F.coalesce("enabled", F.lit(0)))
    return per_state.groupBy("case_id").agg(
        (F.sum("replayed") / F.sum("visits")).alias("fitness"),
        F.coalesce(
            F.sum(F.col("visits") * F.col("used")) / F.nullif(F.sum(F.col("visits") * F.col("enabled")), F.lit(0)),
            F.lit(0.0),
        ).alias("precision"),
    ).withColumn("f1", f1(F.col("fitness"), F.col("precision")))
