"""Aggregates over graded samples: pass@k, votes, rewards, score cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import rewards as R
from veritrace.functions import text as X
from veritrace.operators import grading, language, metrics as M, votes as V
from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query

PASS_SQL = """case when c = 0 then 0.0 when n - c < k then 1.0 else
  1.0 - exp(list_sum(list_transform(range(k), lambda i: ln(n - c - i) - ln(n - i)))) end"""


@query("pass_at_k", f"""with {fx.GRADED}, t as (select prompt_id, count(*) as n, count(*) filter (where correct) as c, 4 as k from graded group by prompt_id)
select prompt_id, n, c, round({PASS_SQL}, 6) as pass_at_4 from t""")
def pass_at_k(spark, sf):
    counts = M.sample_counts(fx.graded(spark, sf), ["prompt_id"])
    return counts.select(
        "prompt_id", "n", "c", F.round(M.pass_at_k(F.col("n"), F.col("c"), F.lit(4)), 6).alias("pass_at_4"))


@query("pass_at_k_all", f"""with {fx.GRADED}, t as (select prompt_id, count(*) as n, count(*) filter (where correct) as c from graded group by prompt_id),
tk as (select * from t, (select unnest([1, 2, 4, 8, 16]) as k) where k = 1 or 2 * k <= n)
select prompt_id, k, round({PASS_SQL}, 6) as pass_at_k from tk""")
def pass_at_k_all(spark, sf):
    scores = M.pass_at_all_k(M.sample_counts(fx.graded(spark, sf), ["prompt_id"]))
    return scores.select("prompt_id", "k", F.round("pass_at_k", 6).alias("pass_at_k"))


@query("pass_at_k_by_category", f"""with {fx.GRADED},
t as (select prompt_id, lang, toxic, count(*) as n, count(*) filter (where correct) as c from graded group by all),
tk as (select *, {PASS_SQL} as p from (select * from t, (select unnest([1, 2, 4, 8, 16]) as k) where k = 1 or 2 * k <= n))
select k, 'lang' as category, lang as value, round_even(avg(p) * 100, 1) as percent from tk group by k, lang
union all select k, 'toxic', cast(toxic as varchar), round_even(avg(p) * 100, 1) from tk group by k, toxic
union all select k, 'overall', 'all', round_even(avg(p) * 100, 1) from tk group by k""")
def pass_at_k_by_category(spark, sf):
    counts = M.sample_counts(fx.graded(spark, sf), ["prompt_id", "lang", "toxic"])
    return M.by_category(M.pass_at_all_k(counts), ["lang", "toxic"])


@query("most_common", """with c as (select user_id, event_type, count(*) as votes, min(event_id) as first_pos from events group by all)
select user_id, arg_max(event_type, (votes, -first_pos)) as event_type, max(votes) as votes from c group by user_id""")
def most_common(spark, sf):
    return M.most_common(fx.table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


RAW_ANSWERS = ["1/2", "0.5", "", r"\frac{1}{2}"]
VOTE_CASES = r"""answers as (select *, case when raw in ('1/2', '0.5', '\frac{1}{2}') then 'half' else raw end as canonical from (
  select o_custkey, o_orderkey, case o_orderkey % 6 when 0 then '1/2' when 1 then '0.5' when 2 then '' when 3 then '\frac{1}{2}'
    else cast(o_orderkey % 5 as varchar) end as raw from orders)),
counted as (select o_custkey, canonical, arg_min(raw, o_orderkey) as answer, count(*) as votes, min(o_orderkey) as p from answers group by all)"""


def raw_answers(spark, sf):
    """One sampled answer per order of a customer: three spellings of a half, an empty answer, or a small number."""
    k = F.col("o_orderkey")
    raw = (k % 5).cast("string")
    for i, text in enumerate(RAW_ANSWERS):
        raw = F.when(k % 6 == i, text).otherwise(raw)
    return fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", raw.alias("raw"))


@query("equiv_vote", f"""with {VOTE_CASES},
w as (select o_custkey, arg_max(answer, (votes, -p)) as top, arg_max(votes, (votes, -p)) as top_votes,
  arg_max(answer, (votes, -p)) filter (where answer <> '') as alt, arg_max(votes, (votes, -p)) filter (where answer <> '') as alt_votes
  from counted group by o_custkey)
select o_custkey, case when top = '' and alt is not null then alt else top end as raw,
  case when top = '' and alt is not null then alt_votes else top_votes end as votes from w""")
def equiv_vote(spark, sf):
    return V.class_vote(raw_answers(spark, sf), ["o_custkey"], "raw", "o_orderkey")


@query("majority_grade", f"""with {VOTE_CASES},
w as (select o_custkey, arg_max(canonical, (votes, -p)) as canonical, max(votes) as votes from counted where canonical <> '' group by o_custkey)
select o_custkey, votes, canonical = 'half' as correct from w""")
def majority_grade(spark, sf):
    """The largest class of a customer's extracted answers is graded against one half."""
    boxed = F.concat(F.lit(r"\boxed{"), "raw", F.lit("}"))
    text = raw_answers(spark, sf).withColumn("response", F.when(F.col("raw") == "", "no box").otherwise(boxed))
    extracted = text.withColumn("pred", X.last_boxed(F.col("response"))).where("pred is not null")
    voted = V.class_vote(extracted, ["o_custkey"], "pred", "o_orderkey").withColumn("gold", F.lit("1/2"))
    graded = grading.on_distinct_pairs(voted, ["pred", "gold"], grading.judge_string)
    return graded.select("o_custkey", "votes", "correct")


@query("running_majority", f"""with {VOTE_CASES},
n as (select a.o_custkey, a.o_orderkey, c.answer, count(*) over (partition by a.o_custkey, a.canonical order by a.o_orderkey) as cnt, c.p as f
  from answers a join counted c on c.o_custkey = a.o_custkey and c.canonical = a.canonical),
pairs as (select a.o_custkey, a.o_orderkey, b.answer, max(b.cnt) as cnt, any_value(b.f) as f from n a join n b
  on a.o_custkey = b.o_custkey and b.o_orderkey <= a.o_orderkey group by 1, 2, 3),
r as (select o_custkey, o_orderkey, arg_max(answer, (cnt, -f)) as top, arg_max(answer, (cnt, -f)) filter (where answer <> '') as alt from pairs group by 1, 2)
select o_custkey, o_orderkey, case when top = '' then coalesce(alt, '') else top end as majority from r""")
def running_majority(spark, sf):
    return V.running_class_majority(raw_answers(spark, sf), ["o_custkey"], "raw", "o_orderkey")


@query("top2_answers", """with c as (select user_id, event_type, count(*) as votes, min(event_id) as p from events group by all),
r as (select *, cast(row_number() over (partition by user_id order by votes desc, p) as int) as rank from c)
select user_id, event_type, votes, rank from r where rank <= 2""")
def top2_answers(spark, sf):
    counts = fx.table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("votes"), F.min("event_id").alias("p"))
    return M.top_n(counts, ["user_id"], [F.desc("votes"), F.col("p")], 2).drop("p")


@query("weighted_reward", f"with {fx.REWARDS} select sample_id, round(0.5 * r_acc + 0.3 * r_proc, 6) as reward from rewards")
def weighted_reward(spark, sf):
    total = R.weighted_sum({"r_acc": 0.5, "r_fmt": 0.0, "r_proc": 0.3})
    return fx.rewards(spark, sf).select("sample_id", F.round(total, 6).alias("reward"))


@query("reward_by_batch", f"""with {fx.REWARDS}
select sample_id // 80 as batch, count(*) as n, round(avg(r_acc + r_fmt + r_proc), 6) as mean_reward from rewards group by 1""")
def reward_by_batch(spark, sf):
    total = R.weighted_sum({"r_acc": 1, "r_fmt": 1, "r_proc": 1})
    rows = fx.rewards(spark, sf).select(F.floor(F.col("sample_id") / 80).alias("batch"), total.alias("reward"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"))


@query("group_advantage", f"""with {fx.REWARDS}
select sample_id, prompt_id, round((r_proc - avg(r_proc) over w) / (stddev_samp(r_proc) over w + 1e-4), 6) as advantage
from rewards window w as (partition by prompt_id)""")
def group_advantage(spark, sf):
    scored = M.group_advantage(fx.rewards(spark, sf), "prompt_id", "r_proc")
    return scored.select("sample_id", "prompt_id", F.round("advantage", 6).alias("advantage"))


@query("loo_advantage", f"""with {fx.REWARDS}
select sample_id, prompt_id, round(r_proc - (sum(r_proc) over w - r_proc) / nullif(count(*) over w - 1, 0), 6) as advantage
from rewards window w as (partition by prompt_id)""")
def loo_advantage(spark, sf):
    scored = M.leave_one_out_advantage(fx.rewards(spark, sf), "prompt_id", "r_proc")
    return scored.select("sample_id", "prompt_id", F.round("advantage", 6).alias("advantage"))


ACCURACY = """acc as (select language, level, count(*) as n, count(*) filter (where correct) as c from levels group by all),
pct as (select *, round_even(c * 100.0 / n, 1) as accuracy from acc)"""


@query("level_accuracy", f"with {fx.LEVELS}, {ACCURACY} select language, level, n, accuracy from pct")
def level_accuracy(spark, sf):
    return M.level_accuracy(fx.levels(spark, sf))


@query("weighted_level_score", f"""with {fx.LEVELS}, {ACCURACY},
w as (select *, case level when 'low' then 1 when 'middle' then 2 when 'high' then 4 else 8 end as weight from pct)
select language, case when sum(weight) = 15 then round_even(sum(weight * accuracy) / 15, 1) end as weighted_score from w group by language""")
def weighted_level_score(spark, sf):
    return M.weighted_level_score(M.level_accuracy(fx.levels(spark, sf)))


CARD = {"accuracy": "correct", "thinking_lang_cons": "sample_id % 5 <> 0", "answer_lang_cons": "toxic = 0"}
_CELLS = {(v, m): f"round_even(avg(case when level = '{v}' then ({e})::int end) * 100, 1)" for v in ("low", "middle", "high", "top") for m, e in CARD.items()}


@query("score_card", f"""with {fx.LEVELS}, card as (select language, {", ".join(f"{cell} as {v}_{m}" for (v, m), cell in _CELLS.items())} from levels group by language)
select *, round_even((low_accuracy + 2 * middle_accuracy + 4 * high_accuracy + 8 * top_accuracy) / 15, 1) as benchmark_weighted_accuracy,
{", ".join(f"round_even((low_{m} + middle_{m} + high_{m} + top_{m}) / 4, 1) as benchmark_{m}" for m in ("thinking_lang_cons", "answer_lang_cons"))} from card""")
def score_card(spark, sf):
    """The three published metrics by level, and a benchmark's weighted accuracy and mean consistencies."""
    rows = fx.levels(spark, sf).withColumns({name: F.expr(e).cast("int") for name, e in CARD.items()})
    return M.benchmark_card(rows, {name: name for name in CARD}, weighted="accuracy")


@query("size_audit", f"with {fx.LEVELS} select language, level, count(*) as n, count(*) = 25 as as_expected from levels group by all")
def size_audit(spark, sf):
    return M.size_audit(fx.levels(spark, sf), expected=25)


@query("categories", "select distinct lang from documents order by lang")
def categories(spark, sf):
    return fx.table(spark, sf, "documents").select("lang").distinct().orderBy("lang")


@query("length_stats", """with r as (select lang, n_chars, unnest([case when n_chars > 4096 then 'length' else 'stop' end, 'all']) as finish_reason from documents)
select lang, finish_reason, count(*) as n, round(avg(n_chars), 6) as mean_length, min(n_chars) as min_length, max(n_chars) as max_length,
quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.9) as p90, quantile_disc(n_chars, 0.99) as p99 from r group by all""")
def length_stats(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("reason", F.when(F.col("n_chars") > 4096, "length").otherwise("stop"))
    stats = M.length_stats(docs, "lang", "n_chars", "reason")
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query("length_cap_ablation", """with g as (select d.lang, d.n_chars, l.quality = 1 as ok from documents d join labels l using (doc_id)),
x as (select cap, lang as category, case when ok and n_chars <= cap then 1 else 0 end as hit from g, (select unnest([512, 2048, 8192]) as cap))
select cap, category, sum(hit)::bigint as hits, count(*) as n, round(avg(hit), 6) as accuracy from x group by cube(cap, category)""")
def length_cap_ablation(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(fx.table(spark, sf, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    cells = M.length_cap_ablation(rows, [512, 2048, 8192], "n_chars", "ok", "lang")
    return cells.withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 6))


@query("language_consistency", r"""with plain as (select doc_id, lang, regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]', '', 'g'), '\$[^$]*\$', '', 'g') as text from documents),
chars as (select doc_id, lang, unnest(string_split(lower(text), '')) as c, generate_subscripts(string_split(lower(text), ''), 1) as pos from plain),
triples as (select doc_id, lang, c || lead(c) over w || lead(c, 2) over w as gram from chars window w as (partition by doc_id order by pos)),
grams as (select doc_id, lang, gram, count(*) as n from triples where gram is not null group by all),
counts as (select lang, gram, sum(n) as n from grams group by all), totals as (select lang, sum(n) as t from counts group by lang),
vocab as (select count(distinct gram) as v from grams),
model as (select g.gram, t.lang, ln((coalesce(c.n, 0) + 1) / (t.t + v)) as lp from (select distinct gram from grams) g
  cross join totals t cross join vocab left join counts c on c.gram = g.gram and c.lang = t.lang),
scores as (select doc_id, m.lang as guess, sum(n * lp) as s from grams join model m using (gram) group by all),
best as (select doc_id, arg_max(guess, (s, guess)) as detected from scores group by doc_id)
select lang, count(*) as n, round(avg(case when length(p.text) <= 15 or coalesce(detected = lang, false) then 1 else 0 end) * 100, 1) as percent_consistent
from plain p left join best using (doc_id) group by lang""")
def language_consistency(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", X.strip_math(F.col("text")).alias("text"))
    return language.consistency(docs, "doc_id", "lang", "text")
