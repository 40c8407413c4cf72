"""Rewards, pass@k, votes and score cards. Hot groups are pre-aggregated before any shuffle by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.functions.rules import LEVELS
from veritrace.operators.ordering import MAX_ROWS_PER_TASK, KeySkew, order_within, per_key, running_max_within
from veritrace.operators.skew import join_back
from veritrace.session import materialize

# The candidate values of k.
K_VALUES = [1, 2, 4, 8, 16]


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that at least one of k samples drawn from n, of which c are correct, is correct."""
    def add(acc: Column, i: Column) -> Column:
        return acc + F.log(n - c - i) - F.log(n - i)

    ratio = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), F.lit(0.0), add)
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - F.exp(ratio))


def sample_counts(graded: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    """Samples and correct samples per prompt."""
    return graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("c"))


def valid_k(n: Column) -> Column:
    """1, and every other k with 2k <= n."""
    return F.filter(F.array(*map(F.lit, K_VALUES)), lambda k: (k == 1) | (2 * k <= n))


def pass_at_all_k(counts: DataFrame) -> DataFrame:
    return counts.withColumn("k", F.explode(valid_k(F.col("n")))).withColumn(
        "pass_at_k", pass_at_k(F.col("n"), F.col("c"), F.col("k"))
    )


def by_category(scores: DataFrame, categories: list[str], k: str = "k", score: str = "pass_at_k") -> DataFrame:
    """Mean score per value of each category, and overall, in percent to one decimal. One pass over the scores."""
    sets = [(F.lit(name).alias("category"), F.col(name).cast("string").alias("value")) for name in categories]
    rows = F.array(
        *[F.struct(*pair) for pair in sets],
        F.struct(F.lit("overall").alias("category"), F.lit("all").alias("value")),
    )
    return (
        scores.select(k, score, F.explode(rows).alias("g"))
        .groupBy(k, "g.category", "g.value")
        .agg(F.bround(F.avg(score) * 100, 1).alias("percent"))
    )


def most_common(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Most frequent value per group; ties go to the value seen first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("first_pos"))
    rank = F.struct("votes", -F.col("first_pos"))
    return counted.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max("votes").alias("votes"))


def equivalence_vote(df: DataFrame, keys: list[str], canonical: str, position: str) -> DataFrame:
    """As :func:`most_common` over canonical answers, but an empty winner yields to the best non-empty one."""
    counted = df.groupBy(*keys, canonical).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("first_pos"))
    rank = F.struct("votes", -F.col("first_pos"))
    non_empty = F.when(F.col(canonical) != "", rank)
    winners = counted.groupBy(*keys).agg(
        F.max_by(F.struct(canonical, "votes"), rank).alias("top"),
        F.max_by(F.struct(canonical, "votes"), non_empty).alias("top_non_empty"),
        F.max(non_empty).alias("has_non_empty"),
    )
    chosen = F.when((F.col(f"top.{canonical}") == "") & F.col("has_non_empty").isNotNull(), F.col("top_non_empty")).otherwise(F.col("top"))
    return winners.select(*keys, chosen.alias("w")).select(*keys, f"w.{canonical}", "w.votes")


def running_majority(
    df: DataFrame, keys: list[str], answer: str, position: str, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Majority answer after each sample, ties to the answer seen first, empty answers only as a last resort.

    The running count of an answer never falls, so the leader after a row is the largest (count, first seen)
    pair over the rows so far: a running maximum instead of a comparison of all earlier answers.
    """
    def job(part: DataFrame, skew: KeySkew) -> DataFrame:
        if skew.n_hot == 0:
            # Every (group, answer) is small too: one shuffle by group serves all windows.
            counted = order_within(
                part, [*keys, answer], [position], rank="_count", max_rows=max_rows, skew=skew, co_locate=keys
            ).withColumn("_first", F.min(position).over(Window.partitionBy(*keys, answer)))
        else:
            firsts = part.groupBy(*keys, answer).agg(F.min(position).alias("_first"))
            counted = order_within(part, [*keys, answer], [position], rank="_count", max_rows=max_rows)
            counted = counted.join(firsts, [*keys, answer])
        entry = F.struct(F.col("_count"), (-F.col("_first")).alias("_seen"), F.col(answer).alias("a"))
        led = running_max_within(
            counted, keys, [position],
            {"_lead": entry, "_lead_non_empty": F.when(F.col(answer) != "", entry)}, max_rows, skew,
        )
        leader = F.when(F.col("_lead.a") != "", F.col("_lead.a")).otherwise(F.coalesce("_lead_non_empty.a", F.lit("")))
        return led.select(*keys, position, answer, leader.alias("majority"))

    return per_key(df, keys, max_rows, job)


def with_group(df: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    """Each row with the statistics of its group; rows without a group are a group of their own.

    ``stats`` has the rows of each group as ``n``: rows of large groups are dealt over tasks.
    """
    stats = materialize(stats, "group-statistics")
    return join_back(df, stats.drop("n"), [group], stats.select(group, "n"))


def group_advantage(df: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """Reward relative to its group: (r - mean) / (sample standard deviation + epsilon).

    The group statistics are aggregated first and joined back, so a hot group is never one window partition.
    """
    stats = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"), F.count(F.lit(1)).alias("n"))
    value = (F.col(reward) - F.col("_mean")) / (F.col("_sd") + epsilon)
    return with_group(df, stats, group).withColumn("advantage", value).drop("_mean", "_sd")


def leave_one_out_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward minus the mean reward of the other rows of its group; NULL in a group of one."""
    stats = df.groupBy(group).agg(F.sum(reward).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("n"))
    others = (F.col("_sum") - F.col(reward)) / F.nullif(F.col("_n") - 1, F.lit(0))
    return with_group(df, stats, group).withColumn("advantage", F.col(reward) - others).drop("_sum", "_n")


def level_accuracy(levels: DataFrame) -> DataFrame:
    """Accuracy in percent, one decimal, half to even, per language and level."""
    return levels.groupBy("language", "level").agg(
        F.bround(F.avg(F.col("correct").cast("double")) * 100, 1).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def weighted_level_score(accuracy: DataFrame) -> DataFrame:
    """Level i weighs 2^i; a language that lacks a level has no score."""
    weight = F.lit(None).cast("int")
    for i, level in enumerate(LEVELS):
        weight = F.when(F.col("level") == level, 2 ** i).otherwise(weight)
    total = 2 ** len(LEVELS) - 1
    return accuracy.groupBy("language").agg(
        F.when(F.sum(weight) == total, F.bround(F.sum(weight * F.col("accuracy")) / total, 1)).alias("weighted_score")
    )


def score_card(levels: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row per language, one column per level and metric."""
    return levels.groupBy("language").pivot("level", LEVELS).agg(
        *[F.bround(F.avg(column) * 100, 1).alias(name) for name, column in metrics.items()]
    )


def benchmark_card(levels: DataFrame, metrics: dict[str, str], weighted: str) -> DataFrame:
    """One row per language: each metric per level, the level-weighted score of ``weighted`` and the means of the others.

    Percentages have one decimal, half to even; scores are made from the rounded levels, as published. Level i weighs 2^i.
    A language that lacks a level has no score.
    """
    card = score_card(levels, metrics)
    total, out = 2 ** len(LEVELS) - 1, {}
    for name in metrics:
        cells = [F.col(f"{level}_{name}") for level in LEVELS]
        if name == weighted:
            value = sum((cell * 2 ** i for i, cell in enumerate(cells)), F.lit(0.0)) / total
            out[f"benchmark_weighted_{name}"] = F.bround(value, 1)
        else:
            out[f"benchmark_{name}"] = F.bround(sum(cells, F.lit(0.0)) / len(LEVELS), 1)
    return card.withColumns(out)


def length_stats(df: DataFrame, group: str, length: str, reason: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Response lengths per group and finish reason, and per group over all reasons (``all``), in one pass.

    Percentiles come from a mergeable sketch: the rank of the value given is at most n / ``accuracy`` from the rank asked
    for, so they are exact for groups of up to ``accuracy`` rows. A NULL reason is ``unknown``, a NULL length counts in
    ``n`` alone.
    """
    reasons = F.array(F.coalesce(F.col(reason), F.lit("unknown")), F.lit("all"))
    rows = df.select(F.col(group), F.col(length).alias("_length"), F.explode(reasons).alias("finish_reason"))
    quantiles = [F.percentile_approx("_length", share, accuracy).alias(f"p{share * 100:g}") for share in shares]
    return rows.groupBy(group, "finish_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("mean_length"), F.min("_length").alias("min_length"),
        F.max("_length").alias("max_length"), *quantiles)


def size_audit(levels: DataFrame, expected: int) -> DataFrame:
    return levels.groupBy("language", "level").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "as_expected", F.col("n") == expected
    )


def top_n(counts: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group of an aggregated table; Spark limits each group before the shuffle."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def length_cap_ablation(df: DataFrame, caps: list[int], length: str, correct: str, category: str) -> DataFrame:
    """Accuracy when responses longer than a cap count as wrong, per category and overall."""
    rows = df.select(
        F.explode(F.array(*map(F.lit, caps))).alias("cap"), F.col(category).alias("category"),
        F.col(length).alias("_len"), F.col(correct).alias("_ok"),
    )
    hit = (F.col("_ok") & (F.col("_len") <= F.col("cap"))).cast("int")
    by_both = rows.groupBy("cap", "category").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return by_both.cube("cap", "category").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """Running total over a global order without a single-task window.

    Rows are cut into blocks of ``width`` order values; each block is summed in its own task and the block
    totals, one row per block, are accumulated and joined back.
    """
    block = F.floor(F.col(order) / width)
    rows = df.withColumn("_block", block)
    local = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    return (
        rows.withColumn(name, F.sum(value).over(local)).join(carried, "_block")
        .withColumn(name, F.col(name) + F.col("_carried")).drop("_block", "_carried")
    )
