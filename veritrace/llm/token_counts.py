"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veritrace.llm.common import documents, map_arrow, salted_join, slices, spread_keys
from veritrace.llm.registry import query
from veritrace.llm.tokens import encoder
from veritrace.session import materialize, new_folder

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the options that change counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|no added tokens|special strings as ids").hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty while its folder is not there."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8) and n_tokens of the whole text.

    Texts are known by the SHA-256 of their normalised content (byte-level vocabularies have no normal form but the
    text itself) and counts by that and the tokenizer's version. Digests without a count in the cache are encoded once,
    from the row with the smallest id, and appended to it. A digest with very many rows is dealt over tasks.

    A null text counts as an empty one (0 tokens). Rows with null or repeated ids keep their own row. An empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = materialize(texts.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    known = keyed.groupBy("digest").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_rows"))
    known = materialize(known, "distinct-digests")
    total = known.agg(F.sum("_rows")).first()[0] or 0
    hot = spread_keys(known, "digest", "_rows", total)

    stored = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    misses = known.join(stored, "digest", "left_anti").select(F.col("_id").alias("_first"), F.col("digest").alias("_digest"))
    to_encode = texts.join(
        misses, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("digest") == F.col("_digest")), "left_semi")

    def count(batches):
        enc = encoder(tokenizer)
        for batch in slices(batches):
            counts = [len(enc.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["digest", "version", "n_tokens"])

    new = map_arrow(to_encode.select("digest", "_text"), count, CACHE_SCHEMA)
    new.dropDuplicates(["digest"]).write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    return salted_join(keyed, counts, "digest", "_id", hot).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-count-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
