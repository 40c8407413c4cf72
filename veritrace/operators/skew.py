"""Lookups by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.session import deal, materialize

#: A key is hot beyond this share of all rows, and beyond this many rows. So there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE, HOT_ROWS = 1 / 256, 100_000


def key_counts(df: DataFrame, keys: list[str], label: str = "key-counts") -> DataFrame:
    """The distinct keys and their numbers of rows (``n``), written once; counting partially aggregates."""
    return materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), label)


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame | None:
    """Struct ``_key`` of the keys and the number of tasks to deal each over, or None without such keys.

    Never more rows than ``1 / HOT_SHARE``, whatever the data.
    """
    total = total_rows(counts) if total is None else total
    step = max(hot_rows, math.ceil(total * HOT_SHARE))
    hot = counts.where(F.col("n") > step)
    if hot.isEmpty():
        return None
    return hot.select(F.struct(*keys).alias("_key"), F.least(F.ceil(F.col("n") / step), F.lit(4096)).cast("int").alias("_deals"))


def total_rows(counts: DataFrame) -> int:
    """Rows behind the counts of :func:`key_counts`."""
    return counts.agg(F.sum("n")).first()[0] or 0


def join_back(df: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, hot_rows: int = HOT_ROWS, by_rows: bool = False) -> DataFrame:
    """Every row of ``df`` with the columns of the one row of ``table`` that has its keys; NULL keys match NULL.

    ``counts`` comes from :func:`key_counts` over ``df``. Rows of hot keys are dealt over tasks by a hash of the whole
    row, and the table's row for such a key is sent to each of them; other keys take one plain shuffled join. With
    ``by_rows`` both sides are dealt over a number of tasks that follows the rows (for large tables of thin rows).
    """
    struct = F.struct(*keys)
    left, right = df.withColumn("_key", struct), table.withColumn("_key", struct).drop(*keys)
    total = total_rows(counts)
    hot = hot_keys(counts, keys, hot_rows, total)
    if hot is None:
        if by_rows:
            left, right = deal(left, total, "_key"), deal(right, total, "_key")
        return left.join(right, "_key", "left").drop("_key")
    salt = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_deals")), F.lit(0)).cast("int")
    left = left.join(F.broadcast(hot), "_key", "left").withColumn("_salt", salt).drop("_deals")
    deals = F.sequence(F.lit(0), F.coalesce(F.col("_deals"), F.lit(1)) - 1)
    right = right.join(F.broadcast(hot), "_key", "left").withColumn("_salt", F.explode(deals)).drop("_deals")
    if by_rows:
        left, right = deal(left, total, "_key", "_salt"), deal(right, total, "_key", "_salt")
    return left.join(right, ["_key", "_salt"], "left").drop("_key", "_salt")
