"""Alignment fitness 2·LCS/(|T|+|R|), for traces of any length.

Short pairs are settled in one Arrow batch pass. Long pairs are cut into tiles and solved as a wavefront:
bit-parallel LCS keeps one bit per column of the dynamic programme, and a tile needs only the bits on its top
edge and on its left edge. A round solves every tile of one anti-diagonal of every long case in parallel and
writes the new edges, so no task ever holds a whole long trace and nothing is cut off.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrace.operators.ordering import order_within
from veritrace.session import materialize, new_folder

# Executors need not have this package installed: its few Python functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Traces up to this length are compared in one piece; also the side of a tile for longer ones.
TILE = 65_536


def _tile(gold, reason, top: int, left: list[int] | None) -> tuple[int, list[int]]:
    """Solve one tile; ``top`` has a set bit where the LCS does *not* grow along the upper edge."""
    width = len(reason)
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for j, symbol in enumerate(reason):
        where[symbol] = where.get(symbol, 0) | (1 << j)
    right = []
    for i, symbol in enumerate(gold):
        hit = top & where.get(symbol, 0)
        total = top + hit + (left[i] if left is not None else 0)
        right.append(total >> width)
        top = (total & full) | (top & ~where.get(symbol, 0) & full)
    return top, right


def _lcs_batch(gold: pd.Series, reason: pd.Series) -> pd.Series:
    lengths = []
    for t, r in zip(gold, reason):
        bottom, _ = _tile(t, r, (1 << len(r)) - 1, None)
        lengths.append(len(r) - bin(bottom).count("1"))
    return pd.Series(lengths, dtype="int64")


@F.pandas_udf(T.LongType())
def lcs_length(gold: pd.Series, reason: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two short traces."""
    return _lcs_batch(gold, reason)


def fitness(common: Column, n_gold: Column, n_reason: Column) -> Column:
    total = n_gold + n_reason
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def alignment_of_sides(raw: DataFrame, order: list[str], tile: int = TILE) -> DataFrame:
    """As :func:`alignment_fitness` for rows without step numbers, ordered by ``order``.

    Sizes are counted on the raw rows, and a case that fits one row is sorted only where its traces are collected; step
    numbers are made for long cases alone.
    """
    return _by_size(
        raw, order, lambda rows: order_within(rows, ["case_id", "side"], order, rank="step", co_locate=["case_id"]), tile)


def alignment_fitness(both: DataFrame, tile: int = TILE) -> DataFrame:
    """``both``: case_id, side (R or T), step (dense from 1), activity. One row per case present in both."""
    return _by_size(both, ["step"], lambda rows: rows, tile)


def _by_size(both: DataFrame, order: list[str], numbered: Callable[[DataFrame], DataFrame], tile: int) -> DataFrame:
    sizes = both.groupBy("case_id").agg(
        F.count_if(F.col("side") == "R").alias("n_reason"), F.count_if(F.col("side") == "T").alias("n_gold")
    ).where((F.col("n_reason") > 0) & (F.col("n_gold") > 0))
    longest = sizes.agg(F.max(F.greatest("n_reason", "n_gold")).alias("m")).first()["m"] or 0

    if longest <= tile:
        return _short(both, order)
    long_cases = sizes.where(F.greatest("n_reason", "n_gold") > tile)
    short = _short(both.join(long_cases.select("case_id"), "case_id", "left_anti"), order)
    long_rows = numbered(both.join(long_cases.select("case_id"), "case_id", "left_semi"))
    return short.unionByName(_long(long_rows, long_cases, tile))


def _short(both: DataFrame, order: list[str]) -> DataFrame:
    """Cases no longer than a tile on either side: both traces meet in one row and one Arrow batch pass."""
    def side(name: str) -> Column:
        events = F.collect_list(F.when(F.col("side") == name, F.struct(*order, "activity")))
        return F.transform(F.sort_array(events), lambda e: e["activity"])

    pairs = both.groupBy("case_id").agg(side("T").alias("t"), side("R").alias("r")).where(
        (F.size("t") > 0) & (F.size("r") > 0)
    )
    return pairs.withColumn("common", lcs_length("t", "r")).select(
        "case_id",
        F.size("t").cast("bigint").alias("n_gold"),
        F.size("r").cast("bigint").alias("n_reason"),
        "common",
        fitness(F.col("common"), F.size("t"), F.size("r")).alias("align_fitness"),
    )


def _long(both: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    block = F.floor((F.col("step") - 1) / tile).cast("int").alias("block")
    blocks = (
        both.groupBy("case_id", "side", block)
        .agg(F.sort_array(F.collect_list(F.struct("step", "activity"))).alias("events"))
        .select("case_id", "side", "block", F.transform("events", lambda e: e["activity"]).alias("symbols"))
    )
    blocks = materialize(blocks, "trace-blocks")
    gold = blocks.where("side = 'T'").select("case_id", F.col("block").alias("i"), F.col("symbols").alias("t"))
    reason = blocks.where("side = 'R'").select("case_id", F.col("block").alias("j"), F.col("symbols").alias("r"))
    last = blocks.groupBy("side").agg(F.max("block").alias("b")).collect()  # two rows
    rounds = sum(row["b"] for row in last) + 1

    schema = "case_id string, i int, j int, bottom binary, right binary, common long"
    folder = new_folder(both.sparkSession, "tile-edges")
    edges = both.sparkSession.createDataFrame([], schema)
    for d in range(rounds):
        above = edges.select("case_id", (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("top"))
        beside = edges.select("case_id", "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left"))
        tiles = (
            gold.withColumn("j", d - F.col("i")).join(reason, ["case_id", "j"])
            .join(above, ["case_id", "i", "j"], "left")
            .join(beside, ["case_id", "i", "j"], "left")
            .select("case_id", "i", "j", "t", "r", "top", "left")
        )
        tiles.mapInPandas(_solve_tiles, schema).write.parquet(f"{folder}/round={d}")
        edges = both.sparkSession.read.schema(schema).parquet(f"{folder}/round={d}")
    # The bottom edges of the lowest tile row count where the LCS grew along all columns.
    lowest = gold.groupBy("case_id").agg(F.max("i").alias("i"))
    bottoms = both.sparkSession.read.schema(schema).parquet(folder).join(lowest, ["case_id", "i"], "left_semi")
    common = bottoms.groupBy("case_id").agg(F.sum("common").alias("common"))
    return sizes.join(common, "case_id").select(
        "case_id", "n_gold", "n_reason", "common",
        fitness(F.col("common"), F.col("n_gold"), F.col("n_reason")).alias("align_fitness"),
    )


def _solve_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for case, i, j, t, r, top, left in batch.itertuples(index=False):
            width = len(r)
            start = (1 << width) - 1 if top is None else int.from_bytes(top, "little")
            bottom, right = _tile(t, r, start, None if left is None else list(left))
            rows.append((
                case, i, j, bottom.to_bytes(width // 8 + 1, "little"), bytes(right),
                width - bin(bottom).count("1"),
            ))
        yield pd.DataFrame(rows, columns=["case_id", "i", "j", "bottom", "right", "common"])
