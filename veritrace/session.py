"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "veritrace", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; anything in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Text normalisation is heavy per byte: let a stage keep one partition per core even when it is small.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128kb",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, else one below the warehouse on a single machine.

    A cluster without a shared folder is refused: files in a local folder would be out of sight of other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
    local_path = root.startswith("file:") or "://" not in root
    if local_path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{root.rstrip('/')}/_work"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder, deleted when the session's driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input has fewer splits than the cluster has slots; no shuffle otherwise.

    A table of few row groups cannot be split by the reader, and text work takes longer than dealing its rows anew.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


#: Rows of a task where rows are thin: adaptive execution joins partitions by their compressed bytes, and a few megabytes of
#: keys and numbers may unpack to gigabytes in a sort or a hash table.
ROWS_PER_TASK = 65_536


def deal(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """Rows by ``keys`` over so many tasks that each has about ``ROWS_PER_TASK`` of ``n_rows``; few rows are left as they are."""
    spark = df.sparkSession
    tasks = -(-n_rows // ROWS_PER_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    # With fewer tasks than this a join would shuffle dealt rows once more.
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table, which outlives any lost executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
