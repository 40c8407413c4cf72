"""Named reward columns and their weighted sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions.text import box_count, has

RewardFunction = Callable[[DataFrame], Column]
REWARDS: dict[str, RewardFunction] = {}


def reward(name: str) -> Callable[[RewardFunction], RewardFunction]:
    """Register a reward: a function from the response table to a double column."""
    def register(fn: RewardFunction) -> RewardFunction:
        REWARDS[name] = fn
        return fn
    return register


@reward("format")
def format_reward(df: DataFrame) -> Column:
    """1 when the thinking part is closed."""
    return has(df["response"], "</think>").cast("double")


@reward("single_box")
def single_box(df: DataFrame) -> Column:
    """1 when there is exactly one box."""
    return (box_count(df["response"]) == 1).cast("double")


def with_rewards(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"r_{name}": REWARDS[name](df) for name in names})


def weighted_sum(weights: dict[str, float]) -> Column:
    """Sum of weight times reward column; terms of weight zero are left out."""
    terms = [F.lit(float(w)) * F.col(name) for name, w in weights.items() if w != 0]
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


def gated_score(closed: Column, correct: Column) -> Column:
    """+1 for a correct answer after a closed thinking part, else -1."""
    return F.when(closed & F.coalesce(correct, F.lit(False)), 1.0).otherwise(-1.0)


def three_way_score(extracted: Column, correct: Column) -> Column:
    """-1 without an extracted answer, 1 when correct, -0.5 when wrong."""
    return F.when(extracted.isNull(), -1.0).when(F.coalesce(correct, F.lit(False)), 1.0).otherwise(-0.5)


def json_score(reply: Column, field: str = "score", on_error: float = 0.0, clamp: bool = True) -> Column:
    """Number in a JSON reply; ``on_error`` for anything that is not one."""
    value = F.get_json_object(reply, f"$.{field}").try_cast("double")
    if clamp:
        value = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(value, F.lit(on_error))
