"""Order inside a group without ever putting one big group into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. That is the plan
used when no key is large. When the measured row count of a key passes ``max_rows``, its order range is cut
at quantiles into chunks; each chunk is numbered in its own task and a small table with one row per chunk
carries the running offset and the neighbour across the cut. The result is the same in both cases.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.session import materialize

#: Rows of one key that a single task is asked to sort.
MAX_ROWS_PER_TASK = 2_000_000
#: Hot keys up to this many are broadcast (key plus cut points, well under 100 MB); beyond it they are joined.
MAX_BROADCAST_KEYS = 20_000


@dataclass(frozen=True)
class KeySkew:
    """Measured row counts of the keys beyond the per-task limit."""

    n_hot: int
    largest: int


def measure_skew(df: DataFrame, keys: list[str], max_rows: int = MAX_ROWS_PER_TASK) -> KeySkew:
    """How many keys exceed ``max_rows`` and how large the largest is. One row reaches the driver."""
    row = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max_rows)
        .agg(F.count(F.lit(1)).alias("n_hot"), F.max("n").alias("largest"))
        .first()
    )
    return KeySkew(row["n_hot"] or 0, row["largest"] or 0)


def _maybe_broadcast(side: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(side) if n_rows <= MAX_BROADCAST_KEYS else side


def per_key(
    df: DataFrame, keys: list[str], max_rows: int, job: Callable[[DataFrame, KeySkew], DataFrame]
) -> DataFrame:
    """Run a job whose result rows belong to one key each, hot keys apart from the others.

    The ordinary keys keep the plan with a single shuffle by key; only the hot ones pay for chunks.
    """
    skew = measure_skew(df, keys, max_rows)
    if skew.n_hot == 0:
        return job(df, skew)
    hot = materialize(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(*keys), "hot-keys"
    )
    hot = _maybe_broadcast(hot, skew.n_hot)
    ordinary, heavy = df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")
    return job(ordinary, KeySkew(0, 0)).unionByName(job(heavy, skew))


@dataclass(frozen=True)
class Chunks:
    """Rows with a ``_chunk`` number: 0 for ordinary keys, while a hot key's order range is cut into many."""

    rows: DataFrame
    n_carried: int

    @property
    def cut(self) -> bool:
        return self.n_carried > 0

    def carry(self, keys: list[str], *aggregates: Column) -> DataFrame:
        """One row per chunk of every hot key."""
        return self.rows.where("_hot").groupBy(*keys, "_chunk").agg(*aggregates)

    def join_carried(self, rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(_maybe_broadcast(carried, self.n_carried), [*keys, "_chunk"], "left")


def cut_hot_keys(
    df: DataFrame, keys: list[str], order: list[str], max_rows: int = MAX_ROWS_PER_TASK, skew: KeySkew | None = None
) -> Chunks:
    """Number the chunks each row belongs to. ``order[0]`` must be numeric or a timestamp."""
    skew = skew or measure_skew(df, keys, max_rows)
    if skew.n_hot == 0:
        return Chunks(df, 0)
    axis = F.col(order[0])
    n_chunks = max(2, min(10_000, -(-skew.largest // max_rows)))
    shares = F.array(*[F.lit(i / n_chunks) for i in range(1, n_chunks)])

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(*keys)
    # One short row per hot key; written so that the passes below do not search for hot keys again.
    cuts = materialize(
        df.join(_maybe_broadcast(hot, skew.n_hot), keys, "left_semi")
        .groupBy(*keys).agg(F.array_distinct(F.percentile_approx(axis, shares, 100_000)).alias("_cuts")),
        "chunk-cuts",
    )
    chunk = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut < axis)))
    rows = df.join(_maybe_broadcast(cuts, skew.n_hot), keys, "left").withColumns(
        {"_chunk": chunk, "_hot": F.col("_cuts").isNotNull()}
    )
    return Chunks(rows.drop("_cuts"), skew.n_hot * n_chunks)


def order_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    next_of: list[str] = (),
    rank: str = "rn",
    max_rows: int = MAX_ROWS_PER_TASK,
    skew: KeySkew | None = None,
    co_locate: list[str] | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based position in the group) and ``next_<c>`` for each column in ``next_of``.

    ``order`` must be a total order inside the group and its first column numeric or a timestamp. With
    ``co_locate``, a subset of ``keys``, rows are shuffled on those keys instead when none of them is hot, so
    that later aggregates by them need no further shuffle.
    """
    skew = skew or measure_skew(df, co_locate or keys, max_rows)
    if co_locate and skew.n_hot == 0:
        df = df.repartition(*co_locate)
    cut = cut_hot_keys(df, keys, order, max_rows, skew)
    groups = [*keys, "_chunk"] if cut.cut else keys
    local = Window.partitionBy(*groups).orderBy(*order)
    out = cut.rows.withColumn(rank, F.row_number().over(local).cast("bigint"))
    for name in next_of:
        out = out.withColumn(f"next_{name}", F.lead(name).over(local))
    if cut.cut:
        if next_of:
            out = out.withColumn("_last", F.lead(F.lit(True)).over(local).isNull())
        along = Window.partitionBy(*keys).orderBy("_chunk")
        carried = cut.carry(
            keys, F.count(F.lit(1)).alias("_n"),
            *[F.min_by(F.struct(c), F.struct(*order)).alias(f"_first_{c}") for c in next_of],
        ).select(
            *keys, "_chunk",
            F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
            *[F.lead(f"_first_{c}").over(along)[c].alias(f"_across_{c}") for c in next_of],
        )
        out = cut.join_carried(out, carried, keys).withColumn(rank, F.col(rank) + F.coalesce("_offset", F.lit(0)))
        for name in next_of:
            across = F.when(F.col("_last"), F.col(f"_across_{name}")).otherwise(F.col(f"next_{name}"))
            out = out.withColumn(f"next_{name}", across)
    return out.select(*df.columns, rank, *[f"next_{c}" for c in next_of])


def running_max_within(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], max_rows: int = MAX_ROWS_PER_TASK,
    skew: KeySkew | None = None,
) -> DataFrame:
    """Add, for each named expression, its maximum over the rows up to and including the current one."""
    cut = cut_hot_keys(df, keys, order, max_rows, skew)
    groups = [*keys, "_chunk"] if cut.cut else keys
    local = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.rows.withColumns({name: F.max(value).over(local) for name, value in values.items()})
    if cut.cut:
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = cut.carry(keys, *[F.max(v).alias(f"_max_{n}") for n, v in values.items()]).select(
            *keys, "_chunk", *[F.max(f"_max_{n}").over(earlier).alias(f"_before_{n}") for n in values]
        )
        out = cut.join_carried(out, carried, keys)
        out = out.withColumns({n: F.greatest(F.col(n), F.col(f"_before_{n}")) for n in values})
    return out.select(*df.columns, *values)


def dense_index(df: DataFrame, order: list[str], index: str = "id", start: int = 0) -> DataFrame:
    """Gap-free global position in ``order``, as ``enumerate`` would number the rows.

    The sort is range partitioned, so it scales out; the per-partition counts that shift each partition's
    local numbers are one row per partition. The sorted rows are written once to the shared folder because
    the counts and the numbers must see the same partitioning even after a task is recomputed.
    """
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = materialize(ordered, "dense-index")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(index, F.col("_seq") + F.col("_offset") + F.lit(start))
        .select(index, *[c for c in df.columns if c != index])
    )
