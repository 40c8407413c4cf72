"""Projections over responses, conversations and pages, and the text joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import rewards as R
from veritrace.functions import text as X
from veritrace.operators import joins
from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query


@query("assemble_conversations", f"""select conv_id, turn // {fx.TURNS_PER_TEXT} as part, count(*)::int as n_turns,
md5(string_agg(role || ': ' || text, chr(10) order by turn)) as body_md5 from conversations group by 1, 2""")
def assemble_conversations(spark, sf):
    """Messages of a conversation in turn order, at most 200 turns per row."""
    conv = fx.table(spark, sf, "conversations")
    part = F.floor(F.col("turn") / fx.TURNS_PER_TEXT).alias("part")
    rows = conv.groupBy("conv_id", part).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")
    )
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return rows.select("conv_id", "part", F.size("messages").alias("n_turns"), F.md5(body).alias("body_md5"))


SYSTEM = "Think step by step and put the final answer in a box."


@query("sft_conversations", f"""with m as (select doc_id, '{SYSTEM}' as system, split_part(text, chr(10), 1) as question,
  '<think>' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '</think>' || chr(10) || chr(10) || '\\boxed{{' || doc_id || '}}' as reply from documents)
select doc_id, case when doc_id % 5 = 0 then 2 else 3 end as n_messages, case when doc_id % 5 = 0 then 'system,user' else 'system,user,assistant' end as roles,
md5(system || chr(10) || question || case when doc_id % 5 = 0 then '' else chr(10) || reply end) as content_md5 from m""")
def sft_conversations(spark, sf):
    """A problem table in training form; every fifth problem has no answer and ends with the user's turn."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    answer = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string"))
    messages = X.training_messages(F.substring_index("text", "\n", 1), F.col("text"), answer, F.lit(SYSTEM))
    rows = docs.select("doc_id", messages.alias("m"))
    return rows.select(
        "doc_id", F.size("m").alias("n_messages"), F.array_join(F.col("m.role"), ",").alias("roles"),
        F.md5(F.array_join(F.col("m.content"), "\n")).alias("content_md5"))


@query("valid_conversations", """select conv_id, count(*) as n_turns from conversations group by conv_id
having bool_or(role = 'assistant')""")
def valid_conversations(spark, sf):
    return fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bool_or(F.col("role") == "assistant").alias("ok")
    ).where("ok").drop("ok")


@query("pack_gold_index", f"""with {fx.RESPONSES}
select id, gold || ' <index>' || id || '</index>' as packed from responses""")
def pack_gold_index(spark, sf):
    return fx.responses(spark, sf).select("id", X.pack_index(F.col("gold"), F.col("id")).alias("packed"))


UNPACK_FORMS = ["@g <index>@k</index>", "<index>@k</index> @g <index>7</index>", "  @g  ", "@g <index></index>"]
UNPACK_ANSWER = ["@g", "@g", "@g", "@g"]
UNPACK_INDEX = ["@k", "@k", None, ""]


@query("unpack_gold_index", fx.forms_sql(solution=UNPACK_ANSWER, index=UNPACK_INDEX))
def unpack_gold_index(spark, sf):
    solution, index = X.unpack_index(F.col("packed"))
    return fx.forms(spark, sf, packed=UNPACK_FORMS).select("id", solution.alias("solution"), index.alias("index"))


THINK_FORMS = ["<think> a @k \n</think>\n@g ", "no tag @g", "x<think>b</think>c</think>@g", "y</think> @g", " <think>open @g"]
THINK_THINK = ["a @k", "no tag @g", "b", "y", "<think>open @g"]
THINK_ANSWER = ["@g", "", "c</think>@g", "@g", ""]


@query("split_think_answer", fx.forms_sql(think=THINK_THINK, answer=THINK_ANSWER))
def split_think_answer(spark, sf):
    text = F.col("text")
    return fx.forms(spark, sf, text=THINK_FORMS).select(
        "id", X.thinking(text).alias("think"), X.answer_part(text).alias("answer")
    )


@query("format_reward", f"with {fx.RESPONSES} select id, cast(case when form = 1 then 0 else 1 end as double) as r_format from responses")
def format_reward(spark, sf):
    return R.with_rewards(fx.responses(spark, sf), ["format"]).select("id", "r_format")


@query("single_box_gate", f"""with {fx.RESPONSES}
select id, form not in (1, 4) as eligible from responses""")
def single_box_gate(spark, sf):
    return fx.responses(spark, sf).select("id", (X.box_count(F.col("response")) == 1).alias("eligible"))


@query("gated_score", f"with {fx.RESPONSES} select id, cast(case when form = 0 then 1 else -1 end as double) as score from responses")
def gated_score(spark, sf):
    """The answer follows the last closing tag; here it must equal the gold text."""
    text = F.col("response")
    answer = X.last_boxed(X.after_last(text, "</think>"))
    return fx.responses(spark, sf).select(
        "id", R.gated_score(text.contains("</think>"), answer == F.col("gold")).alias("score")
    )


@query("three_way_score", f"""with {fx.RESPONSES}
select id, cast(case when form = 1 then -1.0 when form = 0 then 1.0 else -0.5 end as double) as score from responses""")
def three_way_score(spark, sf):
    answer = X.last_boxed(F.col("response"))
    return fx.responses(spark, sf).select("id", R.three_way_score(answer, answer == F.col("gold")).alias("score"))


@query("render_prompts", """select item_id, md5('Solve: ' || text || chr(10) || 'Gold: ' || item_id) as prompt_md5,
length('Solve: ' || text || chr(10) || 'Gold: ' || item_id)::int as n_chars from benchmark""")
def render_prompts(spark, sf):
    template = F.lit("Solve: {problem}\nGold: {gold}")
    prompt = F.replace(F.replace(template, F.lit("{problem}"), "text"), F.lit("{gold}"), F.col("item_id").cast("string"))
    return fx.table(spark, sf, "benchmark").select("item_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("n_chars"))


def choice_prompt_column(question, choices):
    """Question, lettered options and the closing list of boxed letters."""
    def letter(i):
        return F.char(F.lit(65) + i)

    options = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("("), letter(i), F.lit(") "), c, F.lit("\n"))), "")
    boxed = F.transform(choices, lambda c, i: F.concat(
        F.when(i == F.size(choices) - 1, "or ").otherwise(""), F.lit(r"\boxed{"), letter(i), F.lit("}")))
    return F.concat(
        question, F.lit("\n\n\n"), options,
        F.lit("\nPlease write your final answer in the form of "), F.array_join(boxed, ", "),
    )


@query("choice_prompt", r"""select p_partkey, p_name || chr(10)||chr(10)||chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || chr(10)
|| case when p_partkey % 2 = 0 then '(C) none' || chr(10) else '' end || chr(10)
|| 'Please write your final answer in the form of \boxed{A}, '
|| case when p_partkey % 2 = 0 then '\boxed{B}, or \boxed{C}' else 'or \boxed{B}' end as prompt from part""")
def choice_prompt(spark, sf):
    choices = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand", "p_type", F.lit("none"))).otherwise(F.array("p_brand", "p_type"))
    parts = fx.table(spark, sf, "part").withColumn("choices", choices)
    return parts.select("p_partkey", choice_prompt_column(F.col("p_name"), F.col("choices")).alias("prompt"))


@query("sample_plan", """select item_id, s::int as sample, (42 + s)::int as seed from benchmark, (select unnest(range(8)) as s)""")
def sample_plan(spark, sf):
    plan = fx.table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample"))
    return plan.withColumn("seed", F.lit(42) + F.col("sample"))


@query("json_score", """select event_id, case when event_id % 5 = 0 then 0.0 else least(greatest(cast(props->>'k' as double), 0), 1) end as clamped,
case when event_id % 5 = 0 then -1.0 else cast(props->>'k' as double) end as raw from events""")
def json_score(spark, sf):
    """Every fifth reply is cut short and no longer JSON."""
    reply = F.when(F.col("event_id") % 5 == 0, F.expr("left(props, 3)")).otherwise(F.col("props"))
    return fx.table(spark, sf, "events").select(
        "event_id", R.json_score(reply, "k").alias("clamped"),
        R.json_score(reply, "k", on_error=-1.0, clamp=False).alias("raw"),
    )


@query("decode_labels", """select l.doc_id, case l.quality when 0 then 'bad' else 'good' end as quality,
case l.toxic when 0 then 'clean' else 'toxic' end as toxic from labels l""")
def decode_labels(spark, sf):
    names = {"quality": ["bad", "good"], "toxic": ["clean", "toxic"]}
    return fx.table(spark, sf, "labels").select(
        "doc_id", *[F.array(*map(F.lit, n))[F.col(c)].alias(c) for c, n in names.items()]
    )


@query("hash_split", """select doc_id, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % 100 < 5 as is_test from documents""")
def hash_split(spark, sf):
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return fx.table(spark, sf, "documents").select("doc_id", (bucket < 5).alias("is_test"))


@query("prompt_budget", r"""with c as (select conv_id, sum(4 + len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')))::bigint + 2 as n_tokens
from conversations group by conv_id)
select conv_id, n_tokens, n_tokens > 400 as over_budget from c""")
def prompt_budget(spark, sf):
    """Four tokens of overhead per message, two per conversation; words stand in for tokens."""
    words = F.size(F.filter(F.split("text", r"\s+", -1), lambda t: t != ""))
    total = fx.table(spark, sf, "conversations").groupBy("conv_id").agg((F.sum(4 + words) + 2).alias("n_tokens"))
    return total.withColumn("over_budget", F.col("n_tokens") > 400)


# ---------------------------------------------------------------- spans

SPAN_TAGS = {"p": ("<p>", "</p>"), "li": ("<li>", "</li>"), "a": ("<a ", "</a>")}


def page_spans(spark, sf, tag, greedy=False):
    opener, closer = SPAN_TAGS[tag]
    found = fx.table(spark, sf, "pages").select("page_id", F.explode(X.spans(F.col("html"), opener, closer, greedy)).alias("s"))
    return found.select("page_id", "s.begin", "s.end")


def spans_sql(tag: str, lazy: str = "?") -> str:
    opener, closer = SPAN_TAGS[tag]
    pattern = f"(?s){opener}.*{lazy}{closer}"
    return f"""(select page_id, pos, sum(gap) over w + coalesce(sum(hit) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0) as b, hit
    from (select page_id, unnest(list_transform(string_split_regex(html, '{pattern}'), lambda g: length(g))) as gap,
                 unnest(list_transform(regexp_extract_all(html, '{pattern}'), lambda m: length(m)) || [null]) as hit,
                 unnest(range(len(string_split_regex(html, '{pattern}')))) as pos from pages)
    window w as (partition by page_id order by pos))"""


@query("extract_spans", f"""with lazy as {spans_sql("p")}, greedy as {spans_sql("p", "")}
select page_id, 'lazy' as mode, b::int as begin_in, (b + hit)::int as end_in, (b + 3)::int as begin_ex, (b + hit - 4)::int as end_ex from lazy where hit is not null
union all select page_id, 'greedy', b::int, (b + hit)::int, (b + 3)::int, (b + hit - 4)::int from greedy where hit is not null""")
def extract_spans(spark, sf):
    """Inclusive and exclusive offsets, shortest and longest matches."""
    def shown(mode, greedy):
        return page_spans(spark, sf, "p", greedy).select(
            "page_id", F.lit(mode).alias("mode"), F.col("begin").alias("begin_in"), F.col("end").alias("end_in"),
            (F.col("begin") + 3).alias("begin_ex"), (F.col("end") - 4).alias("end_ex"),
        )

    return shown("lazy", False).unionByName(shown("greedy", True))


@query("span_overlaps", f"""with p as {spans_sql("a")}, li as {spans_sql("li")}
select p.page_id, p.b::int as l_begin, (p.b + p.hit)::int as l_end, li.b::int as r_begin, (li.b + li.hit)::int as r_end
from p join li on p.page_id = li.page_id and p.hit is not null and li.hit is not null
and p.b < li.b + li.hit and li.b < p.b + p.hit""")
def span_overlaps(spark, sf):
    return joins.overlaps(page_spans(spark, sf, "a"), page_spans(spark, sf, "li"), "page_id")


MATH_FORMS = ["Text $$x\n+@g$$ and \\(a\\) rest of it", "only $@g$ here", "\\[ @g \\] tail words follow after", "plain @k words without formulas"]
MATH_CLEAN = ["Text  and  rest of it", "only  here", " tail words follow after", "plain @k words without formulas"]


@query("strip_math", f"select id, plain, length(plain) <= 15 as short from ({fx.forms_sql(plain=MATH_CLEAN)})")
def strip_math(spark, sf):
    plain = fx.forms(spark, sf, text=MATH_FORMS).select("id", X.strip_math(F.col("text")).alias("plain"))
    return plain.withColumn("short", F.length("plain") <= 15)


# ---------------------------------------------------------------- text joins

def graded_texts(spark, sf):
    """Every document with the benchmark text it is graded against, and the benchmark texts."""
    bench = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("gold_id"), "text")
    n_items = bench.count()
    docs = fx.texts(spark, sf, "documents", F.col("doc_id").alias("pred_id"), (F.col("doc_id") % n_items).alias("gold_id"), "text")
    return docs, bench


TOKENS_SQL = r"""dt as (select doc_id, tok, count(*) as n from (
  select doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\s\p{Z}]+')) as tok from documents) where tok <> '' group by all),
bt as (select item_id, tok, count(*) as n from (
  select item_id, unnest(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\s\p{Z}]+')) as tok from benchmark) where tok <> '' group by all),
pairs as (select doc_id, doc_id % (select count(*) from benchmark) as item_id from documents),
ds as (select doc_id, sum(n) as n from dt group by 1), bs as (select item_id, sum(n) as n from bt group by 1),
co as (select p.doc_id, sum(least(dt.n, bt.n)) as n from pairs p join dt using (doc_id) join bt on bt.item_id = p.item_id and bt.tok = dt.tok group by 1),
sim as (select p.doc_id, p.item_id, coalesce(ds.n, 0) as pn, coalesce(bs.n, 0) as gn, coalesce(co.n, 0) as cn
  from pairs p left join ds using (doc_id) left join bs on bs.item_id = p.item_id left join co on co.doc_id = p.doc_id),
f as (select *, case when pn = 0 and gn = 0 then 1.0 when pn = 0 or gn = 0 or cn = 0 then 0.0 else 2.0 * cn / (pn + gn) end as f1 from sim)"""


@query("token_f1_join", f"""with {TOKENS_SQL} select doc_id as pred_id, item_id as gold_id, pn::bigint as pred_tokens, gn::bigint as gold_tokens,
cn::bigint as common, round(f1, 6) as f1 from f""")
def token_f1_join(spark, sf):
    return joins.token_overlap(*graded_texts(spark, sf)).withColumn("f1", F.round("f1", 6))


@query("multiset_intersect", f"""with {TOKENS_SQL}
select p.doc_id, dt.tok as token, least(dt.n, bt.n) as n from pairs p join dt using (doc_id) join bt on bt.item_id = p.item_id and bt.tok = dt.tok""")
def multiset_intersect(spark, sf):
    shared = joins.shared_tokens(*graded_texts(spark, sf))
    return shared.select(F.col("pred_id").alias("doc_id"), F.explode("shared").alias("t")).select("doc_id", "t.token", "t.n")


@query("number_match", f"""with {fx.RESPONSES}
select id, form in (0, 1, 4) or (form = 2 and gold_n = 0) or (form = 3 and 7 <= 1e-6 * greatest(1.0, gold_n))
  or (form = 0 and id = gold_n) or (form = 4 and gold_n = 1) or (form = 5 and gold_n = 2) as matched from responses""")
def number_match(spark, sf):
    matched = X.any_number_match(X.numbers(F.col("response")), X.numbers(F.col("gold")))
    return fx.responses(spark, sf).select("id", matched.alias("matched"))


@query("answer_similarity", rf"""with {TOKENS_SQL},
nums as (select p.doc_id, bool_or(abs(a.x - b.x) <= 1e-6 * greatest(1.0, abs(b.x))) as hit from pairs p
  join (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), lambda z: try_cast(z as double)))) as x from documents) a using (doc_id)
  join (select item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), lambda z: try_cast(z as double)))) as x from benchmark) b on b.item_id = p.item_id
  where abs(a.x) < 1e300 and abs(b.x) < 1e300 group by 1)
select f.doc_id as pred_id, f.item_id as gold_id, case when coalesce(nums.hit, false) then 1.0 else round(f1, 6) end as similarity
from f left join nums on nums.doc_id = f.doc_id""")
def answer_similarity(spark, sf):
    """1 when some number of the prediction matches one of the gold text, else token F1."""
    docs, bench = graded_texts(spark, sf)
    hits = docs.select("pred_id", "gold_id", X.numbers(F.col("text")).alias("p")).join(
        bench.select("gold_id", X.numbers(F.col("text")).alias("g")), "gold_id"
    ).select("pred_id", X.any_number_match(F.col("p"), F.col("g")).alias("hit"))
    return joins.token_overlap(docs, bench).join(hits, "pred_id").select(
        "pred_id", "gold_id", F.when(F.col("hit"), 1.0).otherwise(F.round("f1", 6)).alias("similarity"))
