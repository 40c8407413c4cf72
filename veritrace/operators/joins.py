"""Joins that the lookups and comparisons of the grading jobs amount to."""

from __future__ import annotations

import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrace.functions.text import tokens
from veritrace.operators.skew import join_back, key_counts

# Executors need not have this package installed: its few Python functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of half-open spans of one key that overlap.

    Both sides are binned by position and joined on (key, bin). A pair is reported only in the bin that holds
    the larger begin, which both spans share exactly once, so no de-duplication shuffle follows.
    """
    def binned(df: DataFrame, side: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("begin") / width), F.floor((F.greatest(F.col("end") - 1, F.col("begin"))) / width))
        return df.select(
            key, F.col("begin").alias(f"{side}_begin"), F.col("end").alias(f"{side}_end"), F.explode(bins).alias("bin")
        )

    pairs = binned(left, "l").join(binned(right, "r"), [key, "bin"])
    return pairs.where(
        (F.col("l_begin") < F.col("r_end")) & (F.col("r_begin") < F.col("l_end"))
        & (F.col("bin") == F.floor(F.greatest("l_begin", "r_begin") / width))
    ).drop("bin")


def _shared(a: list[str] | None, b: list[str] | None) -> list[tuple[str, int]]:
    return [] if a is None or b is None else list((Counter(a) & Counter(b)).items())


#: Row by row: an Arrow batch would hold the tokens of 10,000 texts of any length in each Python worker.
_shared_column = F.udf(_shared, T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])), useArrow=False)


def shared_tokens(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """Each prediction with the tokens it shares with its gold text: pred_id, gold_id, pred_tokens, gold_tokens, shared.

    ``predictions``: pred_id, gold_id, text; ``golds``: gold_id, text. A gold text is split once, its tokens go to the
    predictions that use it (those of a hot gold text are dealt over tasks), and the multisets meet in the row: no token is
    shuffled by itself. A NULL text, and a gold_id without a gold text, has no tokens.
    """
    split = golds.select("gold_id", tokens(F.coalesce("text", F.lit(""))).alias("_gold"))
    mine = predictions.select("pred_id", "gold_id", tokens(F.coalesce("text", F.lit(""))).alias("_pred"))
    both = join_back(mine, split, ["gold_id"], key_counts(predictions, ["gold_id"], "gold-uses"))
    return both.select(
        "pred_id", "gold_id", F.size("_pred").cast("bigint").alias("pred_tokens"),
        F.coalesce(F.size("_gold"), F.lit(0)).cast("bigint").alias("gold_tokens"), _shared_column("_pred", "_gold").alias("shared"))


def token_overlap(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """Multiset token overlap and F1 of each prediction with its gold text; inputs as in :func:`shared_tokens`."""
    both = shared_tokens(predictions, golds)
    common = F.aggregate("shared", F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    found = both.select("pred_id", "gold_id", "pred_tokens", "gold_tokens", common.alias("common"))
    return found.withColumn("f1", token_f1(F.col("pred_tokens"), F.col("gold_tokens"), F.col("common")))


def token_f1(n_pred: Column, n_gold: Column, common: Column) -> Column:
    """Two empty texts agree fully; one empty text or no common token scores 0."""
    return (
        F.when((n_pred == 0) & (n_gold == 0), 1.0)
        .when((n_pred == 0) | (n_gold == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (n_pred + n_gold))
    )


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``: what a resumed job still has to do."""
    return df.join(done.select(key), key, "left_anti")


def missing_keys(spark, n: int, present: DataFrame, key: str) -> DataFrame:
    """Numbers 0..n-1 absent from ``present``; the range is generated in parallel."""
    return spark.range(n).withColumnRenamed("id", key).join(present.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """Left lookup with a default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
