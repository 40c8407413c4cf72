"""Contiguous shards of least capacity over ordered atomic groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import documents
from veritrace.llm.registry import query
from veritrace.session import materialize

#: Atomic groups in order: texts by hash. Equal texts share one, and their number is fixed whatever the data.
BUCKETS = 16_384
#: Rows of a bucket that are numbered by one task; larger buckets are dealt over several.
BUCKET_ROWS = 1000

#: Buckets of at least the mean size of what is left, largest first, take a shard each.
_GIANTS = """
aggregate(
  array_sort(sizes, (x, y) -> case when x.size > y.size then -1 when x.size < y.size then 1 else x.bucket - y.bucket end),
  struct(aggregate(sizes, bigint(0), (t, x) -> t + x.size) as left, {shards} as shards, array_repeat(0, 0) as giants),
  (acc, x) -> if(acc.shards > 1 and x.size * acc.shards >= acc.left,
    struct(acc.left - x.size as left, acc.shards - 1 as shards, array_append(acc.giants, x.bucket) as giants), acc))
"""
#: Binary search: the smallest capacity with which filling shards greedily needs no more of them than there are.
_CAPACITY = """
aggregate(
  sequence(1, 62),
  struct(greatest(coalesce(array_max(transform(rest, x -> x.size)), 0), floor(peeled.left / peeled.shards)) as lo, greatest(peeled.left, 0) as hi),
  (range, step) -> if(range.lo >= range.hi, range,
    if(aggregate(
        rest, struct(1 as n, bigint(0) as fill),
        (acc, x) -> if(acc.fill + x.size > range.lo + shiftright(range.hi - range.lo, 1),
          struct(acc.n + 1 as n, x.size as fill), struct(acc.n as n, acc.fill + x.size as fill)), acc -> acc.n) <= peeled.shards,
      struct(range.lo as lo, range.lo + shiftright(range.hi - range.lo, 1) as hi),
      struct(range.lo + shiftright(range.hi - range.lo, 1) + 1 as lo, range.hi as hi)))).hi
"""
#: First bucket of every shard after the first, cutting greedily at that capacity.
_CUTS = """
aggregate(
  rest, struct(bigint(0) as fill, array_repeat(0, 0) as cuts),
  (acc, x) -> if(acc.fill + x.size > capacity,
    struct(x.size as fill, array_append(acc.cuts, x.bucket) as cuts), struct(acc.fill + x.size as fill, acc.cuts as cuts))).cuts
"""


_REST = "filter(sizes, x -> not array_contains(peeled.giants, x.bucket))"
_SHARDS = """
transform(sizes, x -> struct(x.bucket as bucket,
  if(array_contains(peeled.giants, x.bucket), cast(array_position(peeled.giants, x.bucket) as int) - 1,
     size(peeled.giants) + size(filter(cuts, c -> c <= x.bucket))) as shard))
"""


def bound(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is then computed once and not at every use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def minimax_cuts(buckets: DataFrame, shards: int) -> DataFrame:
    """``bucket`` and ``shard`` for rows of ``bucket`` and ``size``: at most ``BUCKETS`` rows, so one row holds them all."""
    one = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket", "size"))).alias("all_sizes"))
    body = bound("cuts", _CUTS, _SHARDS)
    for name, value in (("capacity", _CAPACITY), ("rest", _REST), ("peeled", _GIANTS.format(shards=shards)), ("sizes", "all_sizes")):
        body = bound(name, value, body)
    return one.select(F.explode(F.expr(body)).alias("x")).select("x.*")


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text plus ``row_bytes``), text_crc32, shard and slot, gapless from 0.

    Groups of equal texts are not cut. Groups lie in the order of their text's hash, in a fixed number of buckets, and
    shards are runs of buckets whose largest is as small as can be. A bucket that alone exceeds the mean (a very common
    text) takes a shard of its own, and the rest is divided among the other shards. A null text is an empty one. Null
    ids and repeated rows get slots of their own, slots within a bucket follow the id; fewer groups than shards leave
    shards empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket")), "shard-rows")
    sizes = materialize(rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "buckets")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    step = max(BUCKET_ROWS, total // BUCKETS * 4)
    plan = minimax_cuts(sizes, shards).join(sizes.select("bucket", F.ceil(F.col("rows") / step).cast("int").alias("_deals")), "bucket")
    plan = materialize(plan, "shard-plan")
    deal = F.pmod(F.xxhash64("_id"), F.col("_deals")).cast("int")
    dealt = rows.join(F.broadcast(plan), "bucket").withColumn("_deal", deal)
    before = Window.partitionBy("shard").orderBy("bucket", "_deal").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard", "bucket", "_deal").count().select(
        "bucket", "_deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # at most 1.25 * BUCKETS rows
    number = F.row_number().over(Window.partitionBy("bucket", "_deal").orderBy("_id", "text_crc32"))
    numbered = dealt.withColumn("_number", number).join(F.broadcast(firsts), ["bucket", "_deal"])
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_first") + F.col("_number") - 1).alias("slot"))


@query("op3_shard_documents")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
