"""Helpers that several operators share."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than this share of all rows is dealt over several tasks.
HOT_SHARE = 1 / 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors, once a session."""
    context = df.sparkSession.sparkContext
    if not any(name.startswith("veritrace-code") for name in (str(f).rpartition("/")[2] for f in context.listFiles)):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / "veritrace-code.zip"  # read by the driver alone, which serves it to executors
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Hot keys and the number of tasks to deal each over. At most ``1 / HOT_SHARE`` rows, whatever the data."""
    step = max(1000, math.ceil(total * HOT_SHARE))
    return counts.where(F.col(n) > step).select(key, F.ceil(F.col(n) / step).cast("int").alias("_deals"))


def salted_join(left: DataFrame, right: DataFrame, key: str, deal_by: str, hot: DataFrame) -> DataFrame:
    """Left join on a key that is unique in ``right``; rows of hot keys are dealt over tasks by ``deal_by``.

    ``hot`` comes from ``spread_keys``: its size has a fixed bound, so it may be broadcast.
    """
    salt = F.coalesce(F.pmod(F.xxhash64(deal_by), F.col("_deals")), F.lit(0)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_deals"), F.lit(1)) - 1))
    a = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_deals")
    b = right.join(F.broadcast(hot), key, "left").withColumn("_salt", salts).drop("_deals")
    return a.join(b, [key, "_salt"], "left").drop("_salt")
