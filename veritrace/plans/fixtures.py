"""Inputs the queries share, derived from the given tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.operators.ordering import order_within
from veritrace.session import spread

SPLIT_TS = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for per-row text work, spread over all cores when the file has few splits."""
    return spread(table(spark, sf_dir, name).select(*columns))


def ntz(literal: str) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


# ---------------------------------------------------------------- event logs

def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log ordered by (ts, event_id), without step numbers."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("case_id"), "ts", "event_id", F.col("event_type").alias("activity")
    )


ORDER = ["ts", "event_id"]


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_within(raw_log(spark, sf_dir), ["case_id"], ORDER, rank="step")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning (R) and gold (T) halves of every case."""
    return raw_log(spark, sf_dir).withColumn("side", F.when(F.col("ts") < ntz(SPLIT_TS), "R").otherwise("T"))


def stepped_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_within(sides(spark, sf_dir), ["case_id", "side"], ORDER, rank="step", co_locate=["case_id"])


EV_LOG = """ev_log as (
  select cast(user_id as varchar) as case_id, ts, event_id, event_type as activity,
         row_number() over (partition by user_id order by ts, event_id) as step
  from events)"""
SIDES = f"""sides as (
  select case_id, ts, event_id, activity, side,
         row_number() over (partition by case_id, side order by ts, event_id) as step
  from (select *, case when ts < timestamp '{SPLIT_TS}' then 'R' else 'T' end as side from ev_log))"""
SIDE_EDGES = """side_rows as (
  select case_id, side, step, activity, lead(activity) over (partition by case_id, side order by step) as nxt from sides),
side_edges as (
  select case_id, side, src, dst, count(*) as n from (
    select case_id, side, activity as src, coalesce(nxt, '■') as dst from side_rows
    union all
    select case_id, side, '▶', activity from side_rows where step = 1)
  group by all)"""
METRICS = """fit as (
  select t.case_id, sum(case when r.n is not null then t.n else 0 end) / sum(t.n) as fitness
  from (select * from side_edges where side = 'T') t
  left join (select * from side_edges where side = 'R') r using (case_id, src, dst)
  group by t.case_id),
states as (
  select coalesce(t.case_id, r.case_id) as case_id, coalesce(t.src, r.src) as src,
         sum(coalesce(t.n, 0)) as visits, count(r.n) as enabled,
         count(*) filter (where r.n is not null and t.n is not null) as used
  from (select * from side_edges where side = 'T') t
  full join (select * from side_edges where side = 'R') r
    on t.case_id = r.case_id and t.src = r.src and t.dst = r.dst
  group by 1, 2),
prec as (
  select case_id, coalesce(sum(visits * used) / nullif(sum(visits * enabled), 0), 0) as precision
  from states group by case_id),
scores as (
  select case_id, fitness, precision,
         case when fitness + precision > 0 then 2 * fitness * precision / (fitness + precision) else 0 end as f1
  from fit join prec using (case_id)
  where case_id in (select case_id from side_edges where side = 'R'))"""
CONFORMANCE = f"with {EV_LOG}, {SIDES}, {SIDE_EDGES}, {METRICS}"


# ---------------------------------------------------------------- conversations

def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"),
        (F.col("turn") + 1).alias("step"),
        F.col("role").alias("activity"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("description"),
    )


CONV_LOG = """conv_log as (
  select cast(conv_id as varchar) as case_id, turn + 1 as step, role as activity,
         replace(text, chr(10), ' ') as description from conversations)"""

HEADER_LINE = "Case ID,Step,Activity,Description"
#: Turns written into one text; longer conversations continue in further texts, so no text grows without bound.
TURNS_PER_TEXT = 200


def two_digits(number: Column) -> Column:
    """The number as text, with a leading zero below ten."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation with its log embedded as CSV; ids ending in 3 lack the header."""
    conv = table(spark, sf_dir, "conversations")
    quoted = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""'))
    line = F.concat_ws(
        ",", F.col("conv_id").cast("string"), two_digits(F.col("turn") + 1), "role",
        F.concat(F.lit('"'), quoted, F.lit('"')),
    )
    texts = conv.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_TEXT).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines")
    )
    header = F.when(F.col("conv_id") % 10 == 3, F.array()).otherwise(F.array(F.lit(HEADER_LINE)))
    rows = F.transform("lines", lambda r: r["line"])
    return texts.select(
        "conv_id",
        F.array_join(F.concat(F.array(F.lit("Here is the log:")), header, rows), "\n").alias("text"),
    )


# ---------------------------------------------------------------- graded samples

def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("prompt_id"), F.col("doc_id").alias("sample_id"),
        (F.col("quality") == 1).alias("correct"), "lang", "toxic", "quality",
    )


GRADED = """graded as (
  select d.source as prompt_id, d.doc_id as sample_id, l.quality = 1 as correct, d.lang, l.toxic, l.quality
  from documents d join labels l on d.doc_id = l.doc_id)"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    return g.select(
        "prompt_id", "sample_id", F.col("quality").cast("double").alias("r_acc"),
        (1 - F.col("toxic")).cast("double").alias("r_fmt"), ((F.col("sample_id") % 7) / F.lit(6.0)).alias("r_proc"),
    )


REWARDS = GRADED + """, rewards as (
  select prompt_id, sample_id, cast(quality as double) as r_acc, cast(1 - toxic as double) as r_fmt,
         (sample_id % 7) / 6.0 as r_proc from graded)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("low", "middle", "high", "top")])
    return graded(spark, sf_dir).select(
        F.col("lang").alias("language"), names[(F.col("sample_id") % 4).cast("int")].alias("level"),
        "sample_id", "correct", "toxic",
    )


LEVELS = GRADED + """, levels as (
  select lang as language, case sample_id % 4 when 0 then 'low' when 1 then 'middle' when 2 then 'high' else 'top' end as level,
         sample_id, correct, toxic from graded)"""


# ---------------------------------------------------------------- responses with a known truth

def whole_price() -> Column:
    return F.floor("o_totalprice").cast("bigint")


RESPONSE_FORMS = [
    "<think>Order @k.\nSum the lines.</think>The total is \\boxed{@g}",
    "No tag. The answer is: @g",
    "<think>a</think>\\boxed{@100g\\%}",
    "<think>b</think>\\boxed{@7g}",
    "<think>try \\boxed{1}</think>\\boxed{\\text{@g}}",
    "<think>c</think>\\boxed{\\frac{@2g}{2}}",
]


def fill(template: Column) -> Column:
    """Put the order's key (@k), whole price (@g), its multiples and a small digit (@d) into a template."""
    g = whole_price()
    values = {
        "@100g": g * 100, "@2g": g * 2, "@3g": g * 3, "@7g": g + 7, "@g": g, "@k": F.col("o_orderkey"),
        "@d": F.col("o_orderkey") % 7 + 2,
    }
    for mark, value in values.items():
        template = F.replace(template, F.lit(mark), value.cast("string"))
    return template


def fill_sql(template: str) -> str:
    """The same substitution as a SQL expression over ``orders``."""
    g = "cast(floor(o_totalprice) as bigint)"
    out = "'" + template.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    for mark, value in {
        "@100g": f"{g}*100", "@2g": f"{g}*2", "@3g": f"{g}*3", "@7g": f"{g}+7", "@g": g, "@k": "o_orderkey",
        "@d": "o_orderkey%7+2",
    }.items():
        if mark in template:
            out = f"replace({out}, '{mark}', cast({value} as varchar))"
    return out


def choose(values: list, selector: Column) -> Column:
    """Element of a literal list by position, wrapping around."""
    return F.array(*[F.lit(v) for v in values])[(selector % len(values)).cast("int")]


def forms(spark: SparkSession, sf_dir: str, **templates: list[str]) -> DataFrame:
    """Every order with one filled template per column; the order key picks the form."""
    orders = texts(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        *[fill(choose(t, F.col("o_orderkey"))).alias(name) for name, t in templates.items()],
    )


def forms_sql(**templates: list[str]) -> str:
    """SELECT over ``orders`` giving id and, per column, the filled template of each form."""
    columns = []
    for name, t in templates.items():
        branches = " ".join(
            f"when {i} then {fill_sql(x) if isinstance(x, str) else ('null' if x is None else str(x).lower())}"
            for i, x in enumerate(t)
        )
        columns.append(f"case cast(o_orderkey % {len(t)} as int) {branches} end as {name}")
    return f"select o_orderkey as id, {', '.join(columns)} from orders"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = texts(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("id"), whole_price().alias("gold_n"), whole_price().cast("string").alias("gold"),
        F.col("o_orderpriority").alias("priority"),
        fill(choose(RESPONSE_FORMS, F.col("o_orderkey"))).alias("response"),
    )


RESPONSES = f"""responses as (
  select r.id, cast(floor(o.o_totalprice) as bigint) as gold_n, cast(cast(floor(o.o_totalprice) as bigint) as varchar) as gold,
         o.o_orderpriority as priority, r.response, cast(r.id % 6 as int) as form
  from ({forms_sql(response=RESPONSE_FORMS)}) r join orders o on o.o_orderkey = r.id)"""
