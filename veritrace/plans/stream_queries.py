"""Streaming variants; each returns the table its sink holds once everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query
from veritrace.session import new_folder
from veritrace.sources import embedded_csv
from veritrace.streaming import jobs


def events(spark, sf):
    """Events as a log with a real timestamp, which event time needs."""
    return fx.raw_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def staged(df, label, files=None):
    """Write a table as stream input and return its folder."""
    path = new_folder(df.sparkSession, label)
    (df.repartition(files) if files else df).write.parquet(path)
    return path


@query("stream_append", f"""with {fx.CONV_LOG} select cast(case_id as bigint) as conv_id, cast(step as int) as step, activity, description
from conv_log where cast(case_id as bigint) % 10 <> 3""")
def stream_append(spark, sf):
    texts = fx.embedded_texts(spark, sf)
    stream = jobs.read_files(spark, staged(texts, "texts"), texts.schema)
    out, checkpoint = new_folder(spark, "stream-log"), new_folder(spark, "checkpoint")
    parsed = embedded_csv.events(stream, "conv_id", "text").select("conv_id", "step", "activity", "description")
    jobs.run_to_table(parsed, out, checkpoint)
    return spark.read.schema(parsed.schema).parquet(out)


@query("stream_dedup", "select event_id, cast(user_id as varchar) as case_id, event_type as activity from events")
def stream_dedup(spark, sf):
    """Every event arrives twice, the second time after a stop; the restarted query adds nothing."""
    log = events(spark, sf)
    source = staged(log, "events-twice")
    out, checkpoint = new_folder(spark, "stream-dedup"), new_folder(spark, "checkpoint")

    def run():
        stream = jobs.exactly_once(jobs.read_files(spark, source, log.schema), "event_id", "ts", "60 days")
        jobs.run_to_table(stream, out, checkpoint)

    run()
    log.write.mode("append").parquet(source)
    run()
    return spark.read.schema(log.schema).parquet(out).select("event_id", "case_id", "activity")


@query("stream_batches", """select event_type as activity, count(*) as n, 4 as n_batches from events group by event_type""")
def stream_batches(spark, sf):
    """One file per micro-batch, each flushed to its own folder."""
    log = events(spark, sf)
    stream = jobs.read_files(spark, staged(log, "events-files", files=4), log.schema, files_per_trigger=1)
    out = new_folder(spark, "stream-batches")
    jobs.run_batches(stream, jobs.write_batch(out), new_folder(spark, "checkpoint"))
    done = spark.read.parquet(out)
    n_batches = done.agg(F.countDistinct("batch").alias("n")).first()["n"]
    return done.groupBy("activity").agg(F.count(F.lit(1)).alias("n")).withColumn("n_batches", F.lit(n_batches))


@query("stream_summary", """select event_type as activity, count(*) as n, round(avg(value), 6) as mean_value from events group by event_type""")
def stream_summary(spark, sf):
    """A running summary in complete mode; the last batch holds the final state."""
    rows = fx.table(spark, sf, "events").select(F.col("event_type").alias("activity"), "value")
    stream = jobs.read_files(spark, staged(rows, "values", files=3), rows.schema, files_per_trigger=1)
    summary = stream.groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    out = new_folder(spark, "stream-summary")
    jobs.run_batches(summary, jobs.write_batch(out), new_folder(spark, "checkpoint"), mode="complete")
    done = spark.read.parquet(out)
    return done.where(F.col("batch") == done.agg(F.max("batch")).first()[0]).drop("batch")


DELAY = "1 hour"


def finished(spark, stream):
    out = new_folder(spark, "stream-windows")
    jobs.run_to_table(stream, out, new_folder(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g),
w as (select user_id, sid, min(ts) as s, max(ts) + interval 6 hours as e, count(*) as n from s group by all)
select cast(user_id as varchar) as case_id, epoch_us(s) as start_us, epoch_us(e) as end_us, n as n_events from w
where e <= (select max(ts) - interval 1 hour from events)""")
def stream_sessions(spark, sf):
    log = events(spark, sf)
    stream = jobs.read_files(spark, staged(log, "events"), log.schema)
    closed = finished(spark, jobs.sessions(stream, "case_id", "ts", "6 hours", DELAY))
    return closed.select("case_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


@query("stream_activity_counts", """with t as (select 'tumbling' as kind, date_trunc('day', ts) as s, event_type from events
union all select 'sliding', time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - i * interval 6 hours, event_type from events, (select unnest(range(4)) as i)),
w as (select kind, s, event_type, count(*) as n from t group by all)
select kind, epoch(s)::bigint as start_s, event_type as activity, n from w
where s + interval 1 day <= (select max(ts) - interval 1 hour from events)""")
def stream_activity_counts(spark, sf):
    log = events(spark, sf)
    source = staged(log, "events")

    def counted(kind, slide):
        stream = jobs.read_files(spark, source, log.schema)
        done = finished(spark, jobs.activity_counts(stream, "ts", DELAY, "1 day", slide))
        return done.select(F.lit(kind).alias("kind"), F.unix_seconds("start").alias("start_s"), "activity", "n")

    return counted("tumbling", None).unionByName(counted("sliding", "6 hours"))


SECOND_TS = "2024-01-23 00:00:00"
#: Events that turn up only with the third batch, whatever their time.
STRAY = "event_id % 53 = 0"


@query("stream_dfg", f"""with {fx.EV_LOG}, b as (select *, case when {STRAY} then 3 when ts < timestamp '{fx.SPLIT_TS}' then 1
  when ts < timestamp '{SECOND_TS}' then 2 else 3 end as batch from ev_log),
ends as (select case_id, batch, max((ts, event_id)) as last from b group by all),
before as (select b.case_id, b.event_id, max(e.last) as last from b left join ends e on e.case_id = b.case_id and e.batch < b.batch group by all),
placed as (select b.*, w.last is null or (b.ts, b.event_id) > w.last as ok from b join before w on w.case_id = b.case_id and w.event_id = b.event_id),
r as (select activity, lag(activity) over (partition by case_id order by ts, event_id) as prev from placed where ok)
select 'edge' as kind, coalesce(prev, '▶') as src, activity as dst, count(*) as cnt from r group by all
union all select 'late', null, activity, count(*) from placed where not ok group by all""")
def stream_dfg(spark, sf):
    """Three batches with a stop after each; strays of the third come too late for cases that have gone on."""
    log = events(spark, sf)
    first, second = (F.lit(x).cast("timestamp") for x in (fx.SPLIT_TS, SECOND_TS))
    batch = F.when(F.expr(STRAY), 3).when(F.col("ts") < first, 1).when(F.col("ts") < second, 2).otherwise(3)
    source, out, checkpoint = (new_folder(spark, x) for x in ("events-thirds", "stream-dfg", "checkpoint"))
    for number in (1, 2, 3):
        log.where(batch == number).write.mode("append").parquet(source)
        jobs.run_keyed(jobs.keyed_dfg(jobs.read_files(spark, source, log.schema), fx.ORDER), out, checkpoint)
    rows = spark.read.schema(jobs.EDGES).parquet(out)
    return rows.groupBy("kind", "src", F.coalesce("dst", "activity").alias("dst")).agg(F.sum("cnt").alias("cnt"))


@query("stream_late", f"""select count(*) as n_in, count(*) filter (where ts >= timestamp '{fx.SPLIT_TS}') as n_out,
count(*) filter (where ts < timestamp '{fx.SPLIT_TS}') as n_late from events""")
def stream_late(spark, sf):
    """The newer half arrives first; the older half is behind the watermark by then, and the progress counts what it drops."""
    log = events(spark, sf)
    split = F.lit(fx.SPLIT_TS).cast("timestamp")
    source = staged(log.where(F.col("ts") >= split), "events-late")
    out, checkpoint = new_folder(spark, "stream-late"), new_folder(spark, "checkpoint")

    def run():
        stream = jobs.read_files(spark, source, log.schema)
        return jobs.run_to_table(jobs.exactly_once(stream, "event_id", "ts", "1 day"), out, checkpoint)

    runs = [run()]
    log.where(F.col("ts") < split).write.mode("append").parquet(source)
    runs.append(run())
    kept = spark.read.schema(log.schema).parquet(out).agg(F.count(F.lit(1)).alias("n_out"))
    return kept.select(
        F.lit(sum(r.rows_in for r in runs)).alias("n_in"), "n_out", F.lit(sum(r.rows_late for r in runs)).alias("n_late"))
