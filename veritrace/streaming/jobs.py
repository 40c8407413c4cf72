"""Incremental jobs on Structured Streaming: file source, available-now trigger, checkpointed progress."""

from __future__ import annotations

import sys
import threading
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from veritrace.schemas import START

# Executors need not have this package installed: its few Python functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@dataclass
class RunCounts:
    """What the progress reports of one run add up to."""

    rows_in: int = 0
    rows_late: int = 0


class _Progress(StreamingQueryListener):
    """Adds up every progress report of the queries it hears of; a query keeps only its last reports itself."""

    def __init__(self):
        self.counts: dict[str, RunCounts] = {}
        self.ended: dict[str, threading.Event] = {}

    def of(self, run: object) -> tuple[RunCounts, threading.Event]:
        return self.counts.setdefault(str(run), RunCounts()), self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        counts, _ = self.of(event.progress.runId)
        counts.rows_in += event.progress.numInputRows
        counts.rows_late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.of(event.runId)[1].set()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **options: str) -> RunCounts:
    """Process everything available and append it to a parquet table; safe to call again after a stop.

    Returns the rows read and the rows dropped behind the watermark, from the progress of all batches of this run.
    """
    streams, progress = stream.sparkSession.streams, _Progress()
    streams.addListener(progress)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", path).options(**options)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        counts, ended = progress.of(query.runId)
        ended.wait(60)  # reports arrive in order, the end last
    finally:
        streams.removeListener(progress)
    return counts


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Call ``each(batch, batch_id)`` for every micro-batch; ``each`` must give the same result when repeated."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, overwritten when the batch is repeated."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def exactly_once(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First row per key; later copies are dropped as long as they arrive within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, case: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Cases closed by inactivity; a session is emitted once the watermark passes its end."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), case)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(case, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def activity_counts(stream: DataFrame, ts: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Events per activity in tumbling or sliding windows."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, length, slide).alias("w"), "activity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "activity", "n")
    )


EDGES = "kind string, src string, dst string, cnt long, case_id string, activity string, at array<string>"
_edge = Row(*[part.split()[0] for part in EDGES.split(", ")])


class _CaseEdges(StatefulProcessor):
    """Edges of one case. The state is its last placed event: the activity, and the order columns to compare with.

    Works on rows: most cases have few events in a batch, and a data frame for each would take far longer than they do.
    """

    def __init__(self, types: T.StructType, gap_ms: int | None):
        self.types, self.columns, self.gap_ms = types, types.names, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([*self.types.fields, T.StructField("activity", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        events = sorted(((tuple(row[c] for c in self.columns), row["activity"], row["_at"]) for row in rows), key=lambda e: _nulls_last(e[0]))
        before = self.last.get()
        late = []
        if before is not None:
            place = tuple(before)[:-1]
            late = [e for e in events if not _behind(place, e[0])]
            events = [e for e in events if _behind(place, e[0])]
        if events:
            names = [name for _, name, _ in events]
            edges = Counter(zip([before[-1] if before is not None else START, *names[:-1]], names, strict=True))
            self.last.update((*events[-1][0], names[-1]))
            if self.gap_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(events[-1][0][0] // 1000 + self.gap_ms)
            for (a, b), n in edges.items():
                yield _edge("edge", a, b, n, None, None, None)
        for _, name, at in late:
            yield _edge("late", None, None, 1, key[0], name, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _nulls_last(place: tuple) -> tuple:
    return tuple((v is None, v) for v in place)


def _behind(last: tuple, place: tuple) -> bool:
    """Whether ``place`` lies behind ``last``; a NULL against a value does not."""
    for a, b in zip(last, place, strict=True):
        if a != b:
            return a is not None and b is not None and b > a
    return False


_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keyed_dfg(stream: DataFrame, order: list[str], gap: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Edges of a directly-follows graph as events arrive: rows of ``EDGES``, counts of ``edge`` rows add up over batches.

    ``stream`` has case_id, activity and the ``order`` columns. Each case keeps its last placed event as keyed state, of
    which a batch writes only the cases it touches (as a change log). An event that does not lie behind the last one
    placed for its case comes too late to be placed and is a ``late`` row. With ``gap`` (of event time, ``order[0]``) a
    case without new events is forgotten once the watermark passes, and begins anew if it comes back. A case's events of
    one micro-batch are ordered in one task, so the batch size bounds what a hot case needs.
    """
    gap_ms = None
    if gap is not None:
        stream = stream.withWatermark(order[0], delay)
        count, unit = gap.split()
        gap_ms = int(timedelta(**{unit if unit.endswith("s") else f"{unit}s": int(count)}).total_seconds() * 1000)
    times = {f.name for f in stream.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)}
    # Times as microseconds, so a place compares and is kept as plain numbers whatever the zone of a worker.
    place = [(F.unix_micros(F.col(c).cast("timestamp")) if c in times else F.col(c)).alias(f"_{c}") for c in order]
    rows = stream.select("case_id", "activity", *([] if gap is None else [order[0]]), *place,
                         F.array(*[F.col(c).cast("string") for c in order]).alias("_at"))
    types = T.StructType([rows.schema[f"_{c}"] for c in order])
    return rows.groupBy("case_id").transformWithState(
        _CaseEdges(types, gap_ms), EDGES, "Append", "None" if gap is None else "EventTime")


def run_keyed(stream: DataFrame, path: str, checkpoint: str) -> RunCounts:
    """As :func:`run_to_table`, with the state store that keyed state needs."""
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in _ROCKSDB}
    for key, value in _ROCKSDB.items():
        conf.set(key, value)
    try:
        return run_to_table(stream, path, checkpoint)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
