"""File sources and sinks with explicit schemas and resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted multi-line text and doubled quotes."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "error") -> None:
    # Line breaks inside values survive because every such value is quoted; the record separator stays "\n".
    df.write.mode(mode).option("header", True).option("quoteAll", quote_all).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; a missing path is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_run_configs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per run: each file holds one whole JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("run_file", F.input_file_name())


def differing_settings(configs: DataFrame, run: str) -> DataFrame:
    """Number of distinct values of every setting over all runs, after unpivoting."""
    settings = [c for c in configs.columns if c not in (run, "run_file")]
    long = configs.select(run, *[F.col(c).cast("string") for c in settings]).unpivot(
        [run], settings, "setting", "value"
    )
    return long.groupBy("setting").agg(
        F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_runs")
    )


def append_finished(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not at ``path`` yet; running it twice adds nothing. Returns rows added."""
    spark = df.sparkSession
    if path_exists(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key).distinct(), key, "left_anti")
    before = spark.read.schema(df.schema).parquet(path).count() if path_exists(spark, path) else 0
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path).count() - before


def compact(spark: SparkSession, path: str, schema: T.StructType, target: str, file_bytes: int = 256 << 20) -> None:
    """Rewrite many small appended files as files of about ``file_bytes``, once, at the end of a run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    spark.read.schema(schema).parquet(path).coalesce(max(1, -(-held // file_bytes))).write.parquet(target)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def unify(sources: list[tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """Benchmarks with different key names as one table: source, id, problem, answer."""
    out = None
    for name, df, keys in sources:
        part = df.select(F.lit(name).alias("source"), *[F.col(c).cast("string").alias(k) for c, k in keys.items()])
        out = part if out is None else out.unionByName(part)
    return out


def write_run_configs(configs: DataFrame, path: str, run: str) -> None:
    """One folder per run with its settings as one JSON document."""
    documents = configs.select(run, F.to_json(F.struct("*")).alias("value"))
    documents.repartition(run).write.partitionBy(run).text(path)
