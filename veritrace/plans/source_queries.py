"""Scans, sinks and resumable writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.operators import joins
from veritrace.operators.ordering import dense_index
from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query
from veritrace.schemas import PROBLEM
from veritrace.session import new_folder
from veritrace.sources import embedded_csv, files


def problems(spark, sf):
    """Documents as a problem table; ids divisible by 10 have no solution."""
    d = fx.table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Problem, \"quoted\" "), "source").alias("question"),
        F.col("n_chars").cast("string").alias("final_answer"),
        F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("r1_solution_1"),
    )


PROBLEMS = """problems as (
  select doc_id as id, 'Problem, "quoted" ' || source as question, cast(n_chars as varchar) as final_answer,
         case when doc_id % 10 <> 0 then text end as r1_solution_1 from documents)"""
PROBLEM_OUT = "select id, question, final_answer, md5(r1_solution_1) as solution_md5 from problems"


def problem_out(df):
    return df.select("id", "question", "final_answer", F.md5("r1_solution_1").alias("solution_md5"))


@query("scan_csv", f"with {PROBLEMS} {PROBLEM_OUT}")
def scan_csv(spark, sf):
    path = new_folder(spark, "problems-csv")
    files.write_csv(problems(spark, sf), path)
    return problem_out(files.read_csv(spark, path, PROBLEM))


@query("scan_pruned", "select doc_id, source from documents where n_chars > 500")
def scan_pruned(spark, sf):
    return fx.table(spark, sf, "documents").where("n_chars > 500").select("doc_id", "source")


@query("scan_jsonl", """select event_id, user_id, event_type, value, props from events""")
def scan_jsonl(spark, sf):
    path = new_folder(spark, "events-jsonl")
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    files.write_jsonl(events, path)
    absent = files.read_jsonl(spark, f"{path}-absent", events.schema)
    return files.read_jsonl(spark, path, events.schema).unionByName(absent)


@query("sink_jsonl_roundtrip", "select doc_id, lang, source, md5(text) as text_md5 from documents")
def sink_jsonl_roundtrip(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    path = new_folder(spark, "documents-jsonl")
    files.write_jsonl(docs.where("doc_id % 2 = 0"), path)
    files.write_jsonl(docs.where("doc_id % 2 = 1"), path, append=True)
    back = files.read_jsonl(spark, path, docs.schema)
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("sink_csv_quoted_roundtrip", f"with {PROBLEMS} {PROBLEM_OUT} where r1_solution_1 is not null")
def sink_csv_quoted_roundtrip(spark, sf):
    path = new_folder(spark, "solutions-csv")
    files.write_csv(problems(spark, sf).where("r1_solution_1 is not null"), path, quote_all=True)
    return problem_out(files.read_csv(spark, path, PROBLEM))


@query("sink_append_cases", """select cast(conv_id as varchar) as case_id, count(*) as n_events, count(distinct turn) as n_steps
from conversations group by conv_id""")
def sink_append_cases(spark, sf):
    """A first run writes a third of the cases, a second the rest; a third run finds nothing to do."""
    log = fx.conv_log(spark, sf)
    path = new_folder(spark, "event-log")
    files.append_finished(log.where("cast(case_id as bigint) % 3 = 0"), path, "case_id")
    files.append_finished(log, path, "case_id")
    if files.append_finished(log, path, "case_id") != 0:
        raise AssertionError("a repeated run must add nothing")
    return spark.read.schema(log.schema).parquet(path).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("step").alias("n_steps")
    )


@query("sink_results", "select doc_id, cast(quality as double) as accuracy, toxic from labels")
def sink_results(spark, sf):
    """Results appended in two batches, compacted once at the end."""
    results = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("accuracy"), "toxic")
    path, final = new_folder(spark, "results"), new_folder(spark, "results-final")
    results.where("doc_id % 2 = 0").write.mode("append").parquet(path)
    results.where("doc_id % 2 = 1").write.mode("append").parquet(path)
    files.compact(spark, path, results.schema, final)
    return spark.read.schema(results.schema).parquet(final)


@query("convert_format", """select c_custkey, c_name, c_nationkey from customer""")
def convert_format(spark, sf):
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    path = new_folder(spark, "customer-csv")
    files.write_csv(customers, path)
    return files.read_csv(spark, path, customers.schema)


@query("line_counts", r"""select doc_id, (length(text) - length(replace(text, chr(10), '')))::int as n_breaks,
(length(text) - length(replace(text, chr(10), '')) + case when text = '' or right(text, 1) = chr(10) then 0 else 1 end)::int as n_lines
from documents""")
def line_counts(spark, sf):
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    tail = F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    return fx.table(spark, sf, "documents").select("doc_id", breaks.alias("n_breaks"), (breaks + tail).alias("n_lines"))


@query("embedded_csv_to_events", f"""with {fx.CONV_LOG}
select cast(case_id as bigint) as conv_id, case_id, cast(step as int) as step, activity, description from conv_log
where cast(case_id as bigint) % 10 <> 3""")
def embedded_csv_to_events(spark, sf):
    rows = embedded_csv.events(fx.embedded_texts(spark, sf), "conv_id", "text")
    return rows.select("conv_id", "case_id", "step", "activity", "description")


@query("embedded_csv_rejects", """select distinct conv_id, -1 as line_no, 'no header' as reason from conversations
where conv_id % 10 = 3""")
def embedded_csv_rejects(spark, sf):
    return embedded_csv.rejects(fx.embedded_texts(spark, sf), "conv_id", "text")


@query("unify_benchmarks", """select 'benchmark' as source, cast(item_id as varchar) as id, text as problem, cast(item_id as varchar) as answer from benchmark
union all select 'orders', cast(o_orderkey as varchar), o_orderpriority, o_orderstatus from orders
union all select 'parts', cast(p_partkey as varchar), p_name, p_brand from part""")
def unify_benchmarks(spark, sf):
    def keyed(name):
        return fx.table(spark, sf, name)

    bench = keyed("benchmark").select("item_id", "text", F.col("item_id").alias("answer"))
    return files.unify([
        ("benchmark", bench, {"item_id": "id", "text": "problem", "answer": "answer"}),
        ("orders", keyed("orders"), {"o_orderkey": "id", "o_orderpriority": "problem", "o_orderstatus": "answer"}),
        ("parts", keyed("part"), {"p_partkey": "id", "p_name": "problem", "p_brand": "answer"}),
    ])


CAPS = [2048, 4096, 8192, 16384]


def run_grid_rows(spark, sf):
    """Every (source, language) combination that occurs, at every length cap."""
    combos = fx.table(spark, sf, "documents").select("source", "lang").distinct()
    return combos.withColumn("cap", F.explode(F.array(*map(F.lit, CAPS))))


GRID = """grid as (select source, lang, cap from (select distinct source, lang from documents),
  (select unnest([2048, 4096, 8192, 16384]) as cap))"""


@query("run_configs", """with g as (select source as model, cap as max_tokens, 0.6 as temperature,
  case when source < 'src5' then 'simplerl' else 'r1' end as prompt
  from (select distinct source from documents), (select unnest([2048, 4096, 8192, 16384]) as cap))
select 'model' as setting, count(distinct model) as n_values, count(*) as n_runs from g
union all select 'max_tokens', count(distinct max_tokens), count(*) from g
union all select 'temperature', count(distinct temperature), count(*) from g
union all select 'prompt', count(distinct prompt), count(*) from g""")
def run_configs(spark, sf):
    sources = fx.table(spark, sf, "documents").select("source").distinct()
    grid = sources.withColumn("cap", F.explode(F.array(*map(F.lit, CAPS))))
    configs = grid.select(
        F.concat_ws("-", "source", "cap").alias("run"), F.col("source").alias("model"),
        F.col("cap").alias("max_tokens"), F.lit(0.6).alias("temperature"),
        F.when(F.col("source") < "src5", "simplerl").otherwise("r1").alias("prompt"),
    )
    path = new_folder(spark, "run-configs")
    files.write_run_configs(configs, path, "run")
    return files.differing_settings(files.read_run_configs(spark, path, configs.schema), "run")


@query("run_grid", f"""with {GRID}, done as (select distinct d.source, d.lang from documents d join labels l using (doc_id) where l.toxic = 1)
select source, lang, cap from grid where not (cap <= 4096 and (source, lang) in (select (source, lang) from done))""")
def run_grid(spark, sf):
    labels = fx.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    done = fx.table(spark, sf, "documents").join(labels, "doc_id", "left_semi").select("source", "lang").distinct()
    done = done.withColumn("cap", F.explode(F.array(*map(F.lit, CAPS[:2]))))
    return run_grid_rows(spark, sf).join(done, ["source", "lang", "cap"], "left_anti")


# ---------------------------------------------------------------- ids, slices, lookups

@query("canonical_rename", "select o_orderkey as id, o_orderpriority as question, o_orderstatus as final_answer from orders")
def canonical_rename(spark, sf):
    names = {"o_orderkey": "id", "o_orderpriority": "question", "o_orderstatus": "final_answer"}
    return fx.table(spark, sf, "orders").select(*names).withColumnsRenamed(names)


@query("ensure_id", "select row_number() over (order by page_id) - 1 as id, page_id, url from pages")
def ensure_id(spark, sf):
    return dense_index(fx.table(spark, sf, "pages").select("page_id", "url"), ["page_id"])


@query("slice_rows", """select id, event_id, user_id from
(select row_number() over (order by ts, event_id) - 1 as id, event_id, user_id from events) where id >= 100 and id < 600""")
def slice_rows(spark, sf):
    events = fx.table(spark, sf, "events").select("ts", "event_id", "user_id")
    return dense_index(events, ["ts", "event_id"]).where("id >= 100 and id < 600").select("id", "event_id", "user_id")


@query("head_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def head_rows(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("null_policy", f"""with {PROBLEMS}
select id, md5(coalesce(r1_solution_1, '')) as filled_md5, r1_solution_1 is not null as kept from problems""")
def null_policy(spark, sf):
    return problems(spark, sf).select(
        "id", F.md5(F.coalesce("r1_solution_1", F.lit(""))).alias("filled_md5"),
        F.col("r1_solution_1").isNotNull().alias("kept"),
    )


@query("resume_anti", "select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0")
def resume_anti(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    return joins.unseen(orders, done, "o_orderkey")


@query("missing_cases", """select g.doc_id, count(*) over () as n_missing from
(select unnest(range((select max(doc_id) + 1 from documents))) as doc_id) g
where g.doc_id not in (select doc_id from labels) order by g.doc_id limit 20""")
def missing_cases(spark, sf):
    """Count of all missing ids and the first 20 as examples; the report keeps 20, the audit covers every id."""
    n = fx.table(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("n")).first()["n"]
    missing = joins.missing_keys(spark, n, fx.table(spark, sf, "labels"), "doc_id")
    total = missing.count()
    return missing.orderBy("doc_id").limit(20).withColumn("n_missing", F.lit(total).cast("bigint"))


@query("gold_lookup", """select d.doc_id, coalesce(cast(l.quality as varchar), '') as gold from documents d
left join labels l on l.doc_id = d.doc_id""")
def gold_lookup(spark, sf):
    gold = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"))
    return joins.lookup(fx.table(spark, sf, "documents").select("doc_id"), gold, "doc_id", "gold")


@query("positional_lookup", """with d as (select row_number() over (order by doc_id) - 1 as pos, doc_id, source from documents)
select p.page_id, d.doc_id, d.source from pages p join d on d.pos = p.page_id""")
def positional_lookup(spark, sf):
    golds = dense_index(fx.table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], index="pos")
    pages = fx.table(spark, sf, "pages").select("page_id", F.col("page_id").alias("pos"))
    return pages.join(golds, "pos").select("page_id", "doc_id", "source")


@query("merge_results", """select doc_id, greatest(max(quality), 0) as accuracy, true as is_new from labels where doc_id % 2 = 0 group by doc_id
union all select doc_id, 0, false from labels where doc_id % 2 = 1""")
def merge_results(spark, sf):
    """Old results (all zero) and new results for even ids; the newer run wins."""
    labels = fx.table(spark, sf, "labels")
    old = labels.select("doc_id", F.lit(0).alias("accuracy"), F.lit(1).alias("run"))
    new = labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("accuracy"), F.lit(2).alias("run"))
    merged = old.unionByName(new).groupBy("doc_id").agg(F.max_by(F.struct("accuracy", "run"), "run").alias("r"))
    return merged.select("doc_id", "r.accuracy", (F.col("r.run") == 2).alias("is_new"))


@query("latest_by_id", """select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value
from events group by user_id""")
def latest_by_id(spark, sf):
    latest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return fx.table(spark, sf, "events").groupBy("user_id").agg(latest.alias("r")).select("user_id", "r.event_id", "r.value")


@query("progress_by_batch", """select doc_id // 100 as batch, count(*) as n_rows, sum(n_chars)::bigint as n_chars,
sum(count(*)) over (order by doc_id // 100)::bigint as processed from documents group by 1""")
def progress_by_batch(spark, sf):
    from veritrace.operators.metrics import running_total

    docs = fx.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("batch"), "n_chars")
    batches = docs.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    return running_total(batches, "batch", "n_rows", "processed")
