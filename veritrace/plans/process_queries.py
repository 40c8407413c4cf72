"""Event-log and conformance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import text as X
from veritrace.functions.rules import LABEL_RULES
from veritrace.operators import alignment, conformance as conf, eventlog as ev
from veritrace.operators.joins import lookup
from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query
from veritrace.schemas import ACTIVITIES


def r6(name: str):
    return F.round(name, 6).alias(name)


@query("num_cases", "select count(distinct user_id) as n_cases from events")
def num_cases(spark, sf):
    return fx.raw_log(spark, sf).agg(F.countDistinct("case_id").alias("n_cases"))


@query("case_lens", "select cast(user_id as varchar) as case_id, count(*) as n_events from events group by user_id")
def case_lens(spark, sf):
    return fx.raw_log(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


@query("event_log_typed", f"""with {fx.CONV_LOG}
select case_id, cast(step as int) as step, epoch(to_timestamp(step))::bigint as ts_seconds, activity, description from conv_log""")
def event_log_typed(spark, sf):
    log = fx.conv_log(spark, sf).withColumn("step", fx.two_digits(F.col("step")))
    typed = ev.typed(log)
    ev.require_columns(typed, "case_id", "step", "ts", "activity")
    return typed.select("case_id", "step", F.unix_seconds("ts").alias("ts_seconds"), "activity", "description")


@query("event_log_profile", f"""with {fx.CONV_LOG}
select count(*) as n_events, count(distinct case_id) as n_cases, count(*) filter (where case_id is null) as null_case_id,
       count(*) filter (where step is null) as null_step, count(*) filter (where activity is null) as null_activity
from conv_log""")
def event_log_profile(spark, sf):
    log = fx.conv_log(spark, sf)
    ev.require_columns(log, "case_id", "step", "activity")
    return ev.profile(log)


@query("traces", f"""with {fx.EV_LOG}
select case_id, cast((step - 1) // {ev.TRACE_PART} as int) as part, string_agg(activity, '>' order by step) as trace
from ev_log group by 1, 2""")
def traces(spark, sf):
    return ev.traces(fx.ev_log(spark, sf)).select("case_id", "part", F.array_join("trace", ">").alias("trace"))


EDGES = """rows as (select case_id, step, activity, lead(activity) over (partition by case_id order by step) as nxt from ev_log),
edges as (select case_id, activity as src, coalesce(nxt, '■') as dst from rows
          union all select case_id, '▶', activity from rows where step = 1)"""


@query("dfg_by_case", f"with {fx.EV_LOG}, {EDGES} select case_id, src, dst, count(*) as cnt from edges group by all")
def dfg_by_case(spark, sf):
    return ev.dfg_by_case(fx.raw_log(spark, sf), fx.ORDER)


@query("dfg", f"with {fx.EV_LOG}, {EDGES} select src, dst, count(*) as cnt from edges group by all")
def dfg(spark, sf):
    return ev.dfg(fx.raw_log(spark, sf), fx.ORDER)


@query("start_end_activities", f"""with {fx.EV_LOG},
ends as (select case_id, arg_min(activity, step) as s, arg_max(activity, step) as e from ev_log group by case_id)
select 'start' as position, s as activity, count(*) as n_cases from ends group by s
union all select 'end', e, count(*) from ends group by e""")
def start_end_activities(spark, sf):
    log = fx.raw_log(spark, sf).withColumn("step", F.struct(*fx.ORDER))
    return ev.start_end_activities(log)


@query("variants", f"""with {fx.CONV_LOG},
tr as (select case_id, count(*) as n_events, string_agg(activity, '>' order by step) as trace from conv_log group by case_id),
v as (select trace, any_value(n_events) as n_events, count(*) as n_cases, min(case_id) as first_case from tr group by trace)
select n_events, n_cases, round(n_cases / sum(n_cases) over (), 6) as share, first_case, 0 as part, trace from v""")
def variants(spark, sf):
    log = fx.conv_log(spark, sf)
    found = ev.variants(log).select("n_events", "n_cases", "first_case")
    n_cases = log.agg(F.countDistinct("case_id").alias("n")).first()["n"]
    shown = ev.traces(log.join(found.select(F.col("first_case").alias("case_id")), "case_id", "left_semi"))
    return found.join(shown, found["first_case"] == shown["case_id"]).select(
        "n_events", "n_cases", F.round(F.col("n_cases") / n_cases, 6).alias("share"), "first_case", "part",
        F.array_join("trace", ">").alias("trace"),
    )


@query("footprint", f"""with {fx.CONV_LOG},
rows as (select activity as src, lead(activity) over (partition by case_id order by step) as dst from conv_log),
f as (select distinct src, dst from rows where dst is not null),
a as (select distinct activity from conv_log)
select x.activity as src, y.activity as dst,
  case when f.src is not null and b.src is not null then '‖' when f.src is not null then '→'
       when b.src is not null then '←' else '#' end as relation
from a x cross join a y
left join f on f.src = x.activity and f.dst = y.activity
left join f b on b.src = y.activity and b.dst = x.activity""")
def footprint(spark, sf):
    return ev.footprint(ev.dfg(fx.conv_log(spark, sf)))


@query("case_guard", f"""with {fx.EV_LOG}, {fx.SIDES}
select case_id, count(*) filter (where side = 'R') as n_reason, count(*) filter (where side = 'T') as n_gold,
       count(distinct side) = 2 as usable from sides group by case_id""")
def case_guard(spark, sf):
    return fx.sides(spark, sf).groupBy("case_id").agg(
        F.count_if(F.col("side") == "R").alias("n_reason"), F.count_if(F.col("side") == "T").alias("n_gold"),
    ).withColumn("usable", (F.col("n_reason") > 0) & (F.col("n_gold") > 0))


@query("alignment_fitness", f"""with {fx.EV_LOG}, {fx.SIDES},
tr as (select case_id, list(activity order by step) filter (where side = 'T') as t,
              list(activity order by step) filter (where side = 'R') as r from sides group by case_id),
dp as (select case_id, t, r, list_reduce(t, lambda prev, x: list_reduce(range(1, len(r) + 1), lambda acc, j:
         list_append(acc, case when r[j] = x then prev[j] + 1 else greatest(prev[j + 1], acc[j]) end), [0::bigint]),
         list_transform(range(0, len(r) + 1), lambda z: 0::bigint)) as last_row
       from (select case_id, list_transform(t, lambda z: z) as t, r from tr) where len(t) > 0 and len(r) > 0)
select case_id, len(t) as n_gold, len(r) as n_reason, last_row[len(r) + 1] as common,
       round(2.0 * last_row[len(r) + 1] / (len(t) + len(r)), 6) as align_fitness from dp""")
def alignment_fitness(spark, sf):
    return alignment.alignment_of_sides(fx.sides(spark, sf), fx.ORDER).withColumn("align_fitness", r6("align_fitness"))


@query("dfg_fitness", fx.CONFORMANCE + " select case_id, round(fitness, 6) as fitness from scores")
def dfg_fitness(spark, sf):
    return conf.conformance_of_sides(fx.sides(spark, sf), fx.ORDER).select("case_id", r6("fitness"))


@query("escaping_precision", fx.CONFORMANCE + " select case_id, round(precision, 6) as precision from scores")
def escaping_precision(spark, sf):
    return conf.conformance_of_sides(fx.sides(spark, sf), fx.ORDER).select("case_id", r6("precision"))


CONFORMANCE_SQL = fx.CONFORMANCE + """
select case_id, round(fitness, 6) as fitness, round(precision, 6) as precision, round(f1, 6) as f1 from scores"""


@query("conformance", CONFORMANCE_SQL)
def conformance(spark, sf):
    return conf.conformance_of_sides(fx.sides(spark, sf), fx.ORDER).select(
        "case_id", r6("fitness"), r6("precision"), r6("f1")
    )


@query("mixed_process_score", fx.CONFORMANCE + """
select case_id, round(0.7 * f1 + 0.3 * fitness, 6) as score from scores""")
def mixed_process_score(spark, sf):
    scores = conf.conformance_of_sides(fx.sides(spark, sf), fx.ORDER)
    return scores.select("case_id", F.round(0.7 * F.col("f1") + 0.3 * F.col("fitness"), 6).alias("score"))


@query("conformance_with_label", fx.CONFORMANCE + """,
label as (select cast(user_id as varchar) as case_id, arg_min(value > 10, (ts, event_id)) as is_true from events group by user_id)
select s.case_id, l.is_true, round(fitness, 6) as fitness, round(precision, 6) as precision, round(f1, 6) as f1
from scores s left join label l using (case_id)""")
def conformance_with_label(spark, sf):
    scores = conf.conformance_of_sides(fx.sides(spark, sf), fx.ORDER)
    label = fx.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("case_id")).agg(
        F.min_by(F.col("value") > 10, F.struct("ts", "event_id")).alias("is_true")
    )
    return scores.join(label, "case_id", "left").select("case_id", "is_true", r6("fitness"), r6("precision"), r6("f1"))


@query("train_test_conformance", f"""with {fx.EV_LOG}, {EDGES},
split as (select case_id, ('0x' || substr(md5(case_id), 1, 8))::bigint % 100 < 20 as is_test from (select distinct case_id from ev_log)),
model as (select distinct src, dst from edges join split using (case_id) where not is_test),
en as (select src, count(*) as enabled from model group by src),
te as (select e.case_id, e.src, e.dst, count(*) as n, any_value(m.src is not null) as known
       from edges e join split s using (case_id) left join model m on m.src = e.src and m.dst = e.dst
       where is_test group by 1, 2, 3),
st as (select case_id, te.src, sum(n) as visits, sum(case when known then n else 0 end) as replayed,
              count(*) filter (where known) as used, any_value(coalesce(enabled, 0)) as enabled
       from te left join en on en.src = te.src group by 1, 2),
sc as (select case_id, sum(replayed) / sum(visits) as fitness,
              coalesce(sum(visits * used) / nullif(sum(visits * enabled), 0), 0) as precision from st group by 1)
select case_id, round(fitness, 6) as fitness, round(precision, 6) as precision,
       round(case when fitness + precision > 0 then 2 * fitness * precision / (fitness + precision) else 0 end, 6) as f1
from sc""")
def train_test_conformance(spark, sf):
    bucket = F.conv(F.substring(F.md5("case_id"), 1, 8), 16, 10).cast("bigint") % 100
    log = fx.raw_log(spark, sf).withColumn("is_test", bucket < 20)
    model = ev.dfg(log.where(~F.col("is_test")), fx.ORDER)
    scores = conf.log_level_conformance(model, log.where("is_test"), fx.ORDER)
    return scores.select("case_id", r6("fitness"), r6("precision"), r6("f1"))


@query("missing_models", """select cast(c.conv_id as varchar) as case_id, count(*) as n_events from conversations c
where c.conv_id not in (select doc_id from labels) group by c.conv_id""")
def missing_models(spark, sf):
    models = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("case_id"))
    log = fx.conv_log(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))
    return log.join(models, "case_id", "left_anti")


@query("pair_logs", f"""with {fx.CONV_LOG},
r as (select case_id, count(*) as n_reason from conv_log where activity = 'assistant' group by case_id),
t as (select cast(doc_id as varchar) as case_id, 1 as n_gold from labels)
select coalesce(r.case_id, t.case_id) as case_id, coalesce(n_reason, 0) as n_reason, coalesce(n_gold, 0) as n_gold,
  case when r.case_id is null then 'no model' when t.case_id is null then 'no gold' else 'paired' end as status
from r full join t on r.case_id = t.case_id""")
def pair_logs(spark, sf):
    reason = fx.conv_log(spark, sf).where("activity = 'assistant'").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_reason"))
    gold = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.lit(1).alias("n_gold"))
    status = F.when(F.col("n_reason").isNull(), "no model").when(F.col("n_gold").isNull(), "no gold").otherwise("paired")
    return reason.join(gold, "case_id", "full_outer").select(
        "case_id", F.coalesce("n_reason", F.lit(0)).alias("n_reason"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
        status.alias("status"),
    )


@query("cases_in_log", f"""with known as (select distinct conv_id from conversations)
select d.doc_id, d.source, d.n_chars from documents d where d.doc_id in (select conv_id from known)""")
def cases_in_log(spark, sf):
    log = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return fx.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(log, "doc_id", "left_semi")


@query("union_logs", f"""with {fx.EV_LOG}, {fx.CONV_LOG}
select 'events' as log, case_id, step, activity from ev_log
union all select 'conversations', case_id, step, activity from conv_log""")
def union_logs(spark, sf):
    first = fx.ev_log(spark, sf).select(F.lit("events").alias("log"), "case_id", "step", "activity")
    second = fx.conv_log(spark, sf).select(F.lit("conversations").alias("log"), "case_id", "step", "activity")
    return first.unionByName(second)


# ---------------------------------------------------------------- labelled text as a process

#: What the invented prose of a line is introduced with; its length picks one. Some name two rules, the later one first.
OPENINGS = [
    "The problem is", "By definition", "A known identity:", "Our plan is", "By the formula", "We simplify", "Let us substitute",
    "The integral is", "Compare this with", "By the theorem", "Hence, because", "The edge", "It is impossible that", "To interpret it",
    "Check", "An example:", "Alternatively", "Therefore", "The original", "We are done with", "Nothing here", "In the end, given that",
    "The answer to the question, since", "A test of the limit",
]


def opened(line: Column) -> Column:
    return F.concat(F.array(*[F.lit(x) for x in OPENINGS])[F.length(line) % len(OPENINGS)], F.lit(" "), line)


def label(line: Column) -> Column:
    return ev.label_by_rules(opened(line), LABEL_RULES, "Interpret Result")


_OPENED = "(case length(line) % " + str(len(OPENINGS)) + " " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(OPENINGS)) + " end || ' ' || line)"
LABEL_CASE = "case " + " ".join(
    f"when regexp_matches({_OPENED}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])') then '{activity}'" for words, activity in LABEL_RULES) + " else 'Interpret Result' end"
LINES = """lines as (
  select {key} as {key}, row_number() over (partition by {key} order by pos) as step_no, line from (
    select {key}, unnest(string_split_regex({text}, '\\r\\n|\\r|\\n')) as line,
           generate_subscripts(string_split_regex({text}, '\\r\\n|\\r|\\n'), 1) as pos from {table})
  where regexp_matches(line, '\\S'))"""


@query("lines_to_steps", "with " + LINES.format(key="doc_id", text="text", table="documents") + """
select doc_id, step_no::int as step_no, case when step_no < 10 then '0' else '' end || cast(step_no as varchar) as step,
       length(line)::int as n_chars, md5(line) as line_md5 from lines""")
def lines_to_steps(spark, sf):
    steps = ev.lines_to_steps(fx.table(spark, sf, "documents"), "doc_id", "text")
    return steps.select("doc_id", "step_no", "step", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


@query("label_steps", "with " + LINES.format(key="doc_id", text="text", table="documents") + f"""
select doc_id, step_no::int as step_no, {LABEL_CASE} as activity from lines""")
def label_steps(spark, sf):
    steps = ev.lines_to_steps(fx.table(spark, sf, "documents"), "doc_id", "text")
    return steps.select("doc_id", "step_no", label(F.col("line")).alias("activity"))


ACTIVITY_LIST = ", ".join(f"'{a}'" for a in ACTIVITIES)


@query("vocabulary_violations", "with " + LINES.format(key="doc_id", text="text", table="documents") + f""",
labelled as (select {LABEL_CASE} as activity from lines
             union all select event_type from events union all select role from conversations)
select activity, count(*) as n_rows from labelled where activity not in ({ACTIVITY_LIST}) group by activity""")
def vocabulary_violations(spark, sf):
    steps = ev.lines_to_steps(fx.table(spark, sf, "documents"), "doc_id", "text")
    labelled = steps.select(label(F.col("line")).alias("activity"))
    used = labelled.unionByName(fx.raw_log(spark, sf).select("activity")).unionByName(
        fx.conv_log(spark, sf).select("activity"))
    vocabulary = spark.createDataFrame([(a,) for a in ACTIVITIES], "activity string")
    counts = used.groupBy("activity").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(F.broadcast(vocabulary), "activity", "left_anti")  # 20 rows, fixed


def process_scores(spark, sf):
    """Process reward of every document: its thinking lines are the model, its benchmark text is the gold.

    A benchmark text is labelled and counted once and its edges are then joined to the documents that use it.
    """
    n_items = fx.table(spark, sf, "benchmark").count()
    docs = fx.texts(spark, sf, "documents", "doc_id", "text").withColumn(
        "response",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>x"))).otherwise(F.col("text")),
    ).select("doc_id", X.thinking(F.col("response")).alias("think"))

    think = ev.text_transitions(docs, "doc_id", "think", label).groupBy("doc_id", "src", "dst").agg(
        F.count(F.lit(1)).alias("n_reason"))
    gold = ev.text_transitions(fx.table(spark, sf, "benchmark"), "item_id", "text", label).groupBy("item_id", "src", "dst").agg(
        F.count(F.lit(1)).alias("n_gold"))
    ids = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % n_items).alias("item_id"))
    both = think.withColumn("n_gold", F.lit(0).cast("bigint")).unionByName(
        gold.join(ids, "item_id").select("doc_id", "src", "dst", F.lit(0).cast("bigint").alias("n_reason"), "n_gold"))
    edges = both.groupBy(F.col("doc_id").alias("case_id"), "src", "dst").agg(
        F.sum("n_reason").alias("n_reason"), F.sum("n_gold").alias("n_gold"))
    scores = conf.score_edges(edges).withColumnRenamed("case_id", "doc_id")
    return ids.select("doc_id").join(scores, "doc_id", "left").select(
        "doc_id", F.coalesce("f1", F.lit(0.0)).alias("process_reward")
    )


PROCESS_SQL = "with " + LINES.format(key="doc_id", text="text", table="documents") + ", " + LINES.format(
    key="item_id", text="text", table="benchmark").replace("lines as", "gold_lines as") + f""",
sides as (
  select doc_id as case_id, 'R' as side, step_no as step, {LABEL_CASE} as activity from lines
  union all
  select d.doc_id, 'T', step_no, {LABEL_CASE} from gold_lines g
  join documents d on d.doc_id % (select count(*) from benchmark) = g.item_id),
{fx.SIDE_EDGES}, {fx.METRICS},
rewards as (select d.doc_id, coalesce(s.f1, 0) as process_reward from documents d left join scores s on s.case_id = d.doc_id)"""


@query("process_reward", PROCESS_SQL + " select doc_id, round(process_reward, 6) as process_reward from rewards")
def process_reward(spark, sf):
    return process_scores(spark, sf).select("doc_id", r6("process_reward"))


@query("eval_records", PROCESS_SQL + """
select r.doc_id, cast(coalesce(l.quality, 0) as double) as accuracy, round(r.process_reward, 6) as process_reward
from rewards r left join labels l on l.doc_id = r.doc_id""")
def eval_records(spark, sf):
    accuracy = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("accuracy"))
    return process_scores(spark, sf).join(accuracy, "doc_id", "left").select(
        "doc_id", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), r6("process_reward")
    )


@query("eval_summary", PROCESS_SQL + """
select count(*) as n, round(avg(coalesce(l.quality, 0)), 6) as mean_accuracy, round(avg(r.process_reward), 6) as mean_process_reward
from rewards r left join labels l on l.doc_id = r.doc_id""")
def eval_summary(spark, sf):
    records = lookup(
        process_scores(spark, sf),
        fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")),
        "doc_id", "quality", "0",
    )
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("mean_accuracy"),
        F.round(F.avg("process_reward"), 6).alias("mean_process_reward"),
    )
