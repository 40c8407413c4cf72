"""Extraction, normalisation, comparison and grading of answers.

Inputs are answer texts built from every order: the order key picks a form and the order's numbers fill it in.
The SQL states the known truth of each form, so it shares no logic with the expressions under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import compare as C
from veritrace.functions import normalize as N
from veritrace.functions import text as X
from veritrace.operators import grading, scoring
from veritrace.plans import fixtures as fx
from veritrace.plans.registry import query

# ---------------------------------------------------------------- extraction


@query("extract_boxed", f"""with {fx.RESPONSES} select id, case form when 0 then gold when 1 then null
  when 2 then (gold_n * 100) || '\\%' when 3 then cast(gold_n + 7 as varchar) when 4 then '\\text{{' || gold || '}}'
  else '\\frac{{' || gold_n * 2 || '}}{{2}}' end as answer from responses""")
def extract_boxed(spark, sf):
    return fx.responses(spark, sf).select("id", X.last_boxed(F.col("response")).alias("answer"))


ALL_BOXED = [
    (r"\boxed{@g} then \boxed{b{c}@d}", r"@g|b{c}@d", r"@g|b{c}@d"),
    (r"\boxed{a \boxed{@g}}", r"a\boxed{@g}|@g", r"@g"),
    (r"\boxed{open @g", "", ""),
    (r"no box @g", "", ""),
    (r"\boxed{@d}% of \boxed{\frac{1}{2}}", r"@d|\frac{1}{2}", r"@d}|\frac{1}{2}"),
]


@query("extract_all_boxed", fx.forms_sql(boxes=[f[1] for f in ALL_BOXED], judge_boxes=[f[2] for f in ALL_BOXED]))
def extract_all_boxed(spark, sf):
    text = F.col("text")
    return fx.forms(spark, sf, text=[f[0] for f in ALL_BOXED]).select(
        "id", F.array_join(X.all_boxed(X.drop(text, " ")), "|").alias("boxes"),
        F.array_join(X.all_boxed(text, whole_text=False, keep_percent=True), "|").alias("judge_boxes"),
    )


CASCADE = [
    ("So the final answer is $@g$. I hope it is correct.", "@g"),
    (r"try \boxed{1} and \boxed{\text{@g}}", "@g"),
    ("Hence the answer is @g.", "@g"),
    ("it costs 1,@d00 in total", "1@d00"),
    ("nothing here", ""),
    (r"\boxed{open @g", ""),
    ("The answer is: \\dfrac@d3\nsecond line", r"\frac{@d}{3}"),
]


@query("extract_cascade", fx.forms_sql(answer=[f[1] for f in CASCADE]))
def extract_cascade(spark, sf):
    raw = fx.forms(spark, sf, text=[f[0] for f in CASCADE]).withColumn("raw", X.cascade_raw(F.col("text")))
    tidy = raw.withColumn("raw", X.tidy_extracted(F.col("raw")))
    return N.run(tidy, "raw", "answer", N.STRIP).select("id", "answer")


PATTERN = [
    ("No tag. The answer is: @g", "@g", None),
    ("The answer is: @d\nmore text", None, None),
    ("x\nThe final answer is @g", None, "@g"),
    ("The answer is: @g\n", "@g", None),
    ("@g", None, None),
]


@query("extract_by_pattern", fx.forms_sql(answer=[f[1] for f in PATTERN], final_answer=[f[2] for f in PATTERN]))
def extract_by_pattern(spark, sf):
    text = F.col("text")
    return fx.forms(spark, sf, text=[f[0] for f in PATTERN]).select(
        "id", X.by_pattern(text, "The answer is: (.+)$").alias("answer"),
        X.by_pattern(text, "The final answer is (.+)$").alias("final_answer"),
    )


MODES = [  # text, boxed, explicit, speculate
    ("#### @g", "", "", "@g"),
    ("#### the answer is @g", "", "@g", "@g"),
    ("<|start_answer|> @g <|end_answer|>", "", "@g", "@g"),
    ("so @g is the answer", "", "so @g", "@g"),
    (r"\boxed{@g}", "@g", "@g", "@g"),
    ("We get $@d+1$ so", "", "", "@d+1"),
    ("The answer is $@g$.", "", "$@g", "@g"),
    ("This statement is false", "", "False", ""),
    (r"\boxed{\{@d\}, x} and more", r"\{@d\}, x", r"\{@d\}, x", "@d"),
]


@query("extract_modes", fx.forms_sql(**{m: [f[i + 1] for f in MODES] for i, m in enumerate(("boxed", "explicit", "speculate"))}))
def extract_modes(spark, sf):
    texts = fx.forms(spark, sf, text=[f[0] for f in MODES])
    return texts.select("id", *[X.extract_by_mode(F.col("text"), m).alias(m) for m in ("boxed", "explicit", "speculate")])


CHOICES = [("(B).", "B"), ("The answer is c", "C"), ("@g", "@g"), ("Either A or D.", "D"), (": E/", "E"), (" @g. ", "@g")]


@query("choice_letter", fx.forms_sql(letter=[f[1] for f in CHOICES]))
def choice_letter(spark, sf):
    return fx.forms(spark, sf, text=[f[0] for f in CHOICES]).select("id", X.choice_letter(F.col("text")).alias("letter"))


LOCAL = [
    ("@k: Answer: B", "B"), ("答案：C @g", "C"), ("الإجابة: ب", "B"), ("উত্তর: ঢ", "D"), ("Respuesta : Ａ", "A"),
    ("nothing @g", None), ("answer: d", "d"), ("Antwort: E", None),
]


@query("multilingual_choice", fx.forms_sql(letter=[f[1] for f in LOCAL]))
def multilingual_choice(spark, sf):
    texts = fx.forms(spark, sf, text=[f[0] for f in LOCAL])
    return texts.select("id", X.local_choice(F.col("text")).alias("letter"))


# ---------------------------------------------------------------- normalisation profiles


def normalized(spark, sf, cases, steps, before=lambda c: c):
    texts = fx.forms(spark, sf, raw=[c[0] for c in cases]).withColumn("raw", before(F.col("raw")))
    return N.run(texts, "raw", "canonical", steps).select("id", "canonical")


STRING_CASES = [
    (r"\text{@g}", "@g"), (r"@g \text{ cm}", "@g"), (r"\left(@d, @g\right)", "(@d,@g)"), (r"x \in [@d,@g]", "[@d,@g]"),
    (r"\$@g", "@g"), ("$@g.00", "@g"), ("@d %", "@d"), ("@d million", "@d*10^6"), ("@g degrees", "@g"),
    (r"\frac@d3", r"\frac{@d}{3}"), (r"@d \frac{3}{4}", "@d+3/4"), (r"\sqrt@d", r"\sqrt{@d}"), ("@d days", "@d"),
    ("{@g}", "@g"), ("@d and y", "@d,y"), ("@g p.m.", "@g"), (r"\mathrm{@g}", "@g"), (r"@d\%", "@d"), ("-  @g", "-@g"),
    ("7 @d/4", "7+@d/4"), (r"x \text{ or } y", "x,y"), ("Monday @d days", "Monday@ddays"), ("1,@d00,000", "1@d00000"),
    (r"\frac@d", r"\frac@d"), (r"@d\mbox{ inches}", "@d"), ("@g^{\\circ}", "@g"),
]


@query("normalize_string", fx.forms_sql(canonical=[c[1] for c in STRING_CASES]))
def normalize_string(spark, sf):
    return normalized(spark, sf, STRING_CASES, N.STRING, N.strip_currency)


STRIP_CASES = [
    (r"\text{@g}", "@g"), (r"@g\text{ cm}", "@g"), (r"\dfrac{@d}{3}", r"\frac{@d}{3}"), ("@g.00", "@g"), (".@g", "0.@g"),
    ("@d/3", r"\frac{@d}{3}"), (r"\sqrt@d", r"\sqrt{@d}"), (r"x\in[@d,@g]", "[@d,@g]"), (r"@d^\circ", "@d"), ("@g.", "@g"),
    ("-infinity", r"-\infty"), ("3j+@d", "3i+@d"), (r"@d\mbox{kg}", "@d"), (r"\frac@d{7}", r"\frac{@d}{7}"),
    ("sqrt(2)/@d", r"\frac{sqrt(2)}{@d}"), ("@d {cm}^2", "@d"), ("@g,", "@g"), (r"\left(@d,@g\right)", "(@d,@g)"),
    ("@d t", "@d"), (r"\tan@d", r"\tan{@d}"), (r"\$@g\%", "@g%"), (r"@d\cdot x", "@dx"), ("007/@d", "007/@d"),
]


@query("normalize_strip", fx.forms_sql(canonical=[c[1] for c in STRIP_CASES]))
def normalize_strip(spark, sf):
    return normalized(spark, sf, STRIP_CASES, N.STRIP)


MULTI_CASES = [
    (r"\begin{bmatrix}1&@d\end{bmatrix}", r"\begin{pmatrix}1&@d\end{pmatrix}"), ("@d miles", "@d"), (r"\text{@g}", "@g"),
    ("x=@g", "@g"), ("@g.00", "@g"), ("twelve", "12"), (r"@d\%", "@d"), (r"\frac@d3", r"\frac{@d}{3}"),
    (r"(-\infty,\infty)", r"\mathbb{R}"), ("k=@g", "@g"), ("@d/3", r"\frac{@d}{3}"), (".@d", "0.@d"),
    (r"\sqrt@d", r"\sqrt{@d}"), (r"@d \text{ hours}", "@d"), (r"\leq@g", r"\le@g"), (r"\{@d,@g\}", "{@d,@g}"), ("@g.", "@g"),
    (r"@d\cdot 3", r"@d\cdot3"), (r"\$@g", "@g"), ("@d sq m", "@d"), ("zero", "zero"), (r"\emptyset", "{}"),
    (" ".join(["hundred"] * 10), "hundred" * 10), ("one two three", "onetwothree"), ("two point five", "2.5"),
    ("one million two hundred thousand and sixty-one", "1200061"), ("nine hundred billion", "900000000000"),
    ("seven hundred nine hundred", "sevenhundredninehundred"), ("@d p . m", "@d"), ("@d cu cm", "@d"), ("@d degrees", "@d"),
]


@query("normalize_multiling", fx.forms_sql(canonical=[c[1] for c in MULTI_CASES]))
def normalize_multiling(spark, sf):
    return normalized(spark, sf, MULTI_CASES, N.multilingual())


SYMBOLIC_CASES = [
    ("Yes, it is", "True"), ("no", "False"), ("Tues", "Tuesday"), ("@g", "@g"), (r"\$@g", "@g"),
    (r"\left(@d,@g\right)", "(@d,@g)"), (r"\{b@d,a@d\}", "a@d,b@d"), (r"\frac@d3", r"\frac{@d}{3}"),
    ("@d:3", r"\frac{@d}{3}"), ("x=@g", "@g"), ("a=b=@g", "@g"), (r"@d\pm\sqrt2", r"@d-\sqrt{2},@d+\sqrt{2}"), ("@d cm", "@d"),
    ("three", "3"), (r"\text{@g}", "@g"), (r"\mathbf{x}@d", "x@d"), (r"@d^\circ", "@d"), ("@g.000", "@g"), (".@d", "0.@d"),
    (r"\sin x", r"\sin^{1}x"), ("0@d", "@d"), ("(@g)", "@g"), ("(([{@g}]))", "@g"), ("(@d)(@g)", "(@d)(@g)"), ("1<x<@d", "1,x,@d"), ("∞", r"\infty"),
    (r"\begin{pmatrix}1\\@d\end{pmatrix}", r"\begin{array}1\\@d\end{array}"), (r"\text{a\text{b}}@d", r"a\text{b}@d"),
]


@query("normalize_symbolic", fx.forms_sql(canonical=[c[1] for c in SYMBOLIC_CASES]))
def normalize_symbolic(spark, sf):
    texts = fx.forms(spark, sf, raw=[c[0] for c in SYMBOLIC_CASES])
    return N.symbolic(texts, "raw", "canonical").select("id", "canonical")


OLYMPIAD_CASES = [
    (r"\boxed{@g}", "@g"), (r"\boxed{@d} and \boxed{@g}", "@d,@g"), ("The answer\nis $@g$ or $@d$", "@g,@d"),
    (r"x \in [@d,@g]", "[@d,@g]"), (r"@d\%", "@d\\"), (r"\left(@d,@g\right)", "(@d,@g)"), (r"x\approx @g", "x= @g"),
    (r"@d\mathrm{~cm}", "@dcm"), (r"\boxed{@d", None), ("∶@d，@g", "@d,@g"), (r"\boxed{a\boxed{@d}}", r"a\boxed{@d},@d"),
]


@query("normalize_olympiad", fx.forms_sql(canonical=[c[1] for c in OLYMPIAD_CASES]))
def normalize_olympiad(spark, sf):
    return normalized(spark, sf, OLYMPIAD_CASES, N.OLYMPIAD)


# ---------------------------------------------------------------- comparison


def pair_forms(spark, sf, cases):
    return fx.forms(spark, sf, pred=[c[0] for c in cases], gold=[c[1] for c in cases])


def pair_truth(cases) -> str:
    return fx.forms_sql(equal=[c[2] for c in cases])


MATHD_PAIRS = [
    (r"\frac{@d}{4}", r"\frac{@d}{4}", True), ("0.5", r"\frac{1}{2}", True), ("@g", "x=@g", True), ("@g", r"@g\%", True),
    ("(@d,@g)", "( @d, @g )", True), ("@d/4", "@d.0", False), ("@7g", "@g", False), (r"\sqrt{4}", "2", False),
    ("(@d,0.5)", r"(@d,\frac{1}{2})", False), ("[@d,@g]", "(@d,@g)", False), ("1,@d23", "1@d23", True),
    (r"\frac{@d}{2}", "@d/2", True), (r"2\pi", "2pi", True), ("@d feet", "@d", True), ("", "@g", False),
    ("0.75", r"\frac{3}{4}", True), ("(@d, 0.25)", "(@d, 2/8)", True), (r"\frac{2}{4}", r"\frac{1}{2}", True),
    ("2/4", "1/2", False), ("x+@d", "x+@d", True),
]


@query("grade_mathd", pair_truth(MATHD_PAIRS))
def grade_mathd(spark, sf):
    graded = grading.on_distinct_pairs(pair_forms(spark, sf, MATHD_PAIRS), ["pred", "gold"], grading.judge_grade)
    return graded.select("id", F.col("correct").alias("equal"))


TUPLE_PAIRS = [
    ("(@d,@g)", "( @d , @g )", True), ("(@d,@g)", "(@g,@d,1)", False), ("(@d,1/2)", "(@d,0.5)", True),
    ("(@d,@7g)", "(@d,@g)", False), ("@g", "@g", True),
]


@query("tuple_equal", pair_truth(TUPLE_PAIRS))
def tuple_equal(spark, sf):
    same = C.all_pairs_equal(
        C.tuple_items(F.col("pred")), C.tuple_items(F.col("gold")),
        lambda a, b: (a == b) | F.coalesce(C.probe_equal(a, b), F.lit(False)),
    )
    return pair_forms(spark, sf, TUPLE_PAIRS).select("id", same.alias("equal"))


SET_PAIRS = [
    ("@d,@g,1/2", "0.5,@d,@g", True), ("@g,@g", "@g,@d", False), ("@d", "@d,@d", False), ("x,@d", "@d,x", True),
    (r"\sqrt{4},x", "x,2", True), ("@d,@7g", "@g,@d", False),
]


@query("set_equal", pair_truth(SET_PAIRS))
def set_equal(spark, sf):
    same = C.one_to_one_equal(C.split_depth0(F.col("pred")), C.split_depth0(F.col("gold")))
    return pair_forms(spark, sf, SET_PAIRS).select("id", same.alias("equal"))


COVER_PAIRS = [
    ("@d,@d,@g", "@g,@d", True), ("@d", "@d,@d", True), ("@d,x", "@d", False), ("1/2,@g", "@g,0.5,0.5", True), ("x", "y", False),
]


@query("cover_equal", pair_truth(COVER_PAIRS))
def cover_equal(spark, sf):
    same = C.cover_equal(C.split_depth0(F.col("pred")), C.split_depth0(F.col("gold")))
    return pair_forms(spark, sf, COVER_PAIRS).select("id", same.alias("equal"))


DISTINCT = [("a,b,a,@d", "a,b,@d", "b,@d"), ("@g,@g", "@g", "@g"), ("x", "x", "x"), ("p,q,r,p", "p,q,r", "q,r")]


@query("ordered_distinct", fx.forms_sql(distinct_items=[c[1] for c in DISTINCT], last_two=[c[2] for c in DISTINCT]))
def ordered_distinct(spark, sf):
    items = F.split("items", ",")
    return fx.forms(spark, sf, items=[c[0] for c in DISTINCT]).select(
        "id", F.array_join(C.ordered_distinct(items), ",").alias("distinct_items"),
        F.array_join(C.ordered_distinct(items, F.lit(2)), ",").alias("last_two"),
    )


SPLITS = [("@d,(1,@g),[2,3]", "@d|(1,@g)|[2,3]"), ("a , b,", "a|b"), ("(@d,@g)", "(@d,@g)"), ("@g", "@g"), ("f(x,[y,@d]),z", "f(x,[y,@d])|z")]


@query("split_depth0", fx.forms_sql(parts=[c[1] for c in SPLITS]))
def split_depth0(spark, sf):
    return fx.forms(spark, sf, text=[c[0] for c in SPLITS]).select(
        "id", F.array_join(C.split_depth0(F.col("text")), "|").alias("parts"))


PLUS_MINUS = [(r"1\pm@d,@g", "1+@d|1-@d|@g"), ("@g", "@g"), (r"\pm@g", "+@g|-@g")]


@query("expand_pm", fx.forms_sql(parts=[c[1] for c in PLUS_MINUS]))
def expand_pm(spark, sf):
    parts = C.expand_pm(C.split_depth0(F.col("text")))
    return fx.forms(spark, sf, text=[c[0] for c in PLUS_MINUS]).select("id", F.array_join(parts, "|").alias("parts"))


def close_sql(rel: str, tol: str, percent_rel: str | None = None, ranged: bool = False) -> str:
    """The tolerance rule written out over columns p (prediction) and g (gold)."""
    def one(g: str, r: str) -> str:
        return f"abs({g} - p) <= greatest({r} * greatest(abs({g}), abs(p)), {tol})"

    def could(v: str) -> str:
        return f"(({v} > 0 and {v} < 1) or ({v} > 1 and {v} < 100))"

    out = one("g", rel)
    for other in ("(g / 100)", "(g * 100)"):
        extra = f" and {could('p')} and {could(other)}" if ranged else ""
        out += f" or ({one(other, percent_rel or rel)}{extra})"
    return out


NUMBERS_SQL = """n as (select l_orderkey as id, l_linenumber as line, l_extendedprice as g,
  case l_linenumber % 5 when 0 then l_extendedprice when 1 then l_extendedprice * (1 + l_discount / 1000)
    when 2 then l_extendedprice / 100 when 3 then l_extendedprice + 0.0005 else l_discount * 100 end as p0, l_discount as d from lineitem),
m as (select id, line, case when line % 5 = 4 then d else g end as g, p0 as p from n)"""


@query("numeric_equal", f"""with {NUMBERS_SQL} select id, line, {close_sql("1e-4", "0")} as s, {close_sql("1e-9", "1e-3")} as m,
{close_sql("0", "1.01e-8")} as o, {close_sql("1e-9", "1e-8", "1e-3", True)} as e, {close_sql("1e-4", "0", "1e-4", True)} as x from m""")
def numeric_equal(spark, sf):
    """Every tolerance profile over line-item prices and derived near misses."""
    price, discount, line = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_linenumber")
    pred = (
        F.when(line % 5 == 0, price).when(line % 5 == 1, price * (1 + discount / 1000)).when(line % 5 == 2, price / 100)
        .when(line % 5 == 3, price + 0.0005).otherwise(discount * 100)
    )
    gold = F.when(line % 5 == 4, discount).otherwise(price)
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), pred.alias("p"), gold.alias("g"))
    profiles = {"s": "string", "m": "minerva", "o": "olympiad", "e": "symbolic", "x": "multilingual"}
    return rows.select("id", "line", *[C.numeric_equal(F.col("p"), F.col("g"), p).alias(n) for n, p in profiles.items()])


PARSED = [("1,@d34", "1@d34"), ("1{,}@d34", "1@d34"), (r"@d\%", "0.0@d"), ("@d%", "0.0@d"), ("abc@g", None), ("-@g.5", "-@g.5"), ("1e@d", "1e@d")]


@query("parse_numbers", f"select id, try_cast(v as double) as value from ({fx.forms_sql(v=[c[1] for c in PARSED])})")
def parse_numbers(spark, sf):
    return fx.forms(spark, sf, text=[c[0] for c in PARSED]).select("id", C.parse_number(F.col("text")).alias("value"))


FRACTIONS = [("@d/4", True, False, "@d/4"), ("@g", False, True, "@g"), ("@g.5", False, False, "@g.5"), ("7 @d/4", False, False, "7+@d/4"), ("1,@d00", False, True, "1,@d00"), ("x", False, False, "x")]


@query("fraction_rules", fx.forms_sql(is_frac=[c[1] for c in FRACTIONS], is_int=[c[2] for c in FRACTIONS], mixed=[c[3] for c in FRACTIONS]))
def fraction_rules(spark, sf):
    t = F.col("text")
    return fx.forms(spark, sf, text=[c[0] for c in FRACTIONS]).select(
        "id", C.is_fraction(t).alias("is_frac"), C.is_integer(t).alias("is_int"), C.mixed_to_sum(t).alias("mixed"))


INTERVALS = [
    ("(0,@d]", "(0,@d]", True), ("[0,@d]", "(0,@d]", False), (r"(0,1/2)\cup(1,@d)", r"(0,0.5)\cup(1,@d)", True),
    ("(0,@d)", "(0,@d.5)", False), (r"(0,1)\cup(1,@d)", "(0,@d)", False), ("[0,@d)", "Interval.Ropen(0, @d)", True), ("(1,@d)", "Point(1, @d)", True),
    ("Point(@d, @g)", "(@d, @g.0)", True), ("Interval(0, @d)", "Interval.open(0, @d)", False), (r"(-\infty,@d)", r"(-\infty, @d.0)", True),
]


@query("interval_equal", pair_truth(INTERVALS))
def interval_equal(spark, sf):
    named = {c: C.interval_brackets(F.col(c)) for c in ("pred", "gold")}
    return pair_forms(spark, sf, INTERVALS).select("id", C.interval_equal(named["pred"], named["gold"]).alias("equal"))


MATRICES = [
    (r"\begin{pmatrix}1&@d\\2&3\end{pmatrix}", r"\begin{bmatrix} 1 & @d \\ 2 & 3 \end{bmatrix}", True),
    (r"\begin{pmatrix}1&@d\end{pmatrix}", r"\begin{pmatrix}1&@g\end{pmatrix}", False),
    (r"\begin{pmatrix}1\\@d\end{pmatrix}", r"\begin{pmatrix}1&@d\end{pmatrix}", False),
    (r"\begin{pmatrix}\frac{1}{2}&x\end{pmatrix}", r"\begin{pmatrix}0.5&x\end{pmatrix}", True),
    ("@g", r"\begin{pmatrix}@g\end{pmatrix}", None), (r"\begin{pmatrix}1\\@d\end{pmatrix}", "{1,@d.0}", True),
    (r"\begin{pmatrix}1\\@d\end{pmatrix}", "{@d,1,2}", False),
]


@query("matrix_equal", pair_truth(MATRICES))
def matrix_equal(spark, sf):
    return pair_forms(spark, sf, MATRICES).select("id", C.matrix_equal(F.col("pred"), C.set_as_matrix(F.col("gold"))).alias("equal"))


EQUATIONS = [
    ("x=@g", "x=@g", True, "@g"), ("2x+3=@g", "-2x-3=-@g", True, "2x+3=@g"), ("x=@d", "x=@7g", False, "@d"),
    ("k = @d/2", "y", None, "@d/2"), ("abc=@g", "x=1", None, "abc=@g"), ("3y=@d", "3y-@d=0", True, "@d"),
]


@query("equation_value", fx.forms_sql(equal=[c[2] for c in EQUATIONS], value=[c[3] for c in EQUATIONS]))
def equation_value(spark, sf):
    return pair_forms(spark, sf, EQUATIONS).select(
        "id", C.equation_equal(F.col("pred"), F.col("gold")).alias("equal"), C.equation_value(F.col("pred")).alias("value"))


PROBES = [
    (r"\frac{@2g}{2}", "@g", True), (r"\sqrt{4}", "2", True), (r"\sqrt{@d}", "@g", False), (r"2\pi", "6.283185307179586", True),
    ("x+1", "1+x", None), ("x+@d", "x+@d", True), (r"\frac{3\pi}{2}", "4.71238898038469", True), ("7+@d/4", "@7g", False),
    (r"3\sqrt{2}", "4.242640687119286", True), ("1/0", "@g", None),
    ("@d*10^6", "@d000000", True), ("2^10", "1024", True), ("@g+1", "@g", False), (r"\frac{\sqrt{16}}{2}", "2", True), ("@d*3", "3*@d", True),
]


@query("probe_equal", pair_truth(PROBES))
def probe_equal(spark, sf):
    return pair_forms(spark, sf, PROBES).select("id", C.probe_equal(F.col("pred"), F.col("gold")).alias("equal"))


@query("undecided_counts", f"""select case when equal is null then 'undecided' when equal then 'equal' else 'different' end as verdict,
count(*) as n_pairs from ({pair_truth(PROBES)}) group by 1""")
def undecided_counts(spark, sf):
    """Pairs that closed forms cannot decide are counted as such, apart from those that differ."""
    equal = C.probe_equal(F.col("pred"), F.col("gold"))
    verdict = F.when(equal.isNull(), "undecided").when(equal, "equal").otherwise("different")
    return pair_forms(spark, sf, PROBES).select(verdict.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("normalize_datetime", """select event_id, case event_id % 6
  when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%d') when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 3 then strftime(ts, '%H:%M:00') when 4 then strftime(ts, '%H:%M:00') else null end as canonical from events""")
def normalize_datetime(spark, sf):
    patterns = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd HH:mm:ss", "HH:mm", "hh:mm a", "'on' EEEE"]
    shown = F.lit(None).cast("string")
    for i, pattern in enumerate(patterns):
        shown = F.when(F.col("event_id") % 6 == i, F.date_format("ts", pattern)).otherwise(shown)
    return fx.table(spark, sf, "events").select("event_id", C.normalize_datetime(shown).alias("canonical"))


WORDS = [("Yes", "True"), ("not so", "False"), ("Wed", "Wednesday"), ("FRIDAY", "Friday"), ("fri @d", None), ("@g", None), ("it is true", "True")]


@query("normalize_words", fx.forms_sql(word=[c[1] for c in WORDS]))
def normalize_words(spark, sf):
    return fx.forms(spark, sf, text=[c[0] for c in WORDS]).select("id", N.word_answer(F.col("text")).alias("word"))


SCREENS = [("x+y+z", "3", False), ("sqrt(@d)", "0", True), ("2^{@d}", "0", False), ("2^1@d", "0", False), ("pi+e", "1", True), ("1@d0!", "0", False), ("arccos(x)", "4", False), ("a*b+@g", "2", True)]


@query("eval_screen", f"select id, cast(n as int) as n_letters, allowed from ({fx.forms_sql(n=[c[1] for c in SCREENS], allowed=[c[2] for c in SCREENS])})")
def eval_screen(spark, sf):
    t = F.col("text")
    return fx.forms(spark, sf, text=[c[0] for c in SCREENS]).select(
        "id", C.unknown_letters(t).alias("n_letters"), C.may_evaluate(t).alias("allowed"))


# ---------------------------------------------------------------- grading jobs

CLOSE_7 = "7 <= 1e-4 * (gold_n + 7)"


@query("grade_distinct_pairs", f"""with {fx.RESPONSES} select id, case form when 1 then false when 3 then {CLOSE_7} else true end as correct from responses""")
def grade_distinct_pairs(spark, sf):
    pairs = fx.responses(spark, sf).select("id", "gold", X.last_boxed(F.col("response")).alias("pred"))
    return grading.on_distinct_pairs(pairs, ["pred", "gold"], grading.judge_string).select("id", "correct")


@query("accuracy_reward", f"""with {fx.RESPONSES} select id, cast(case form when 1 then 0 when 3 then case when {CLOSE_7} then 1 else 0 end else 1 end as double) as reward from responses""")
def accuracy_reward(spark, sf):
    """Gold unpacked from its index tag; boxed answers by value, texts without a box by their letters."""
    rows = fx.responses(spark, sf).withColumn("packed", X.pack_index(F.col("gold"), F.col("id")))
    gold, _ = X.unpack_index(F.col("packed"))
    answer = X.answer_part(F.col("response"))
    rows = rows.select("id", gold.alias("gold"), answer.alias("answer"), X.last_boxed(answer).alias("pred"))
    graded = grading.on_distinct_pairs(rows, ["pred", "gold"], grading.judge_string)
    same_text = F.lower(X.strip(F.col("answer"))) == F.lower(X.strip(F.col("gold")))
    correct = F.when(F.col("pred").isNull(), same_text).otherwise(F.col("correct"))
    return graded.select("id", correct.cast("double").alias("reward"))


def judges():
    """Boxed answer, then answer pattern, then the cascade under the grading profile."""
    def by(extract, judge):
        def run(pairs):
            return judge(pairs.withColumn("pred", extract(F.col("response"))))
        return run

    def cascade_judge(pairs):
        raw = pairs.withColumn("pred", X.tidy_extracted(X.cascade_raw(F.col("response"))))
        return grading.judge_grade(N.run(raw, "pred", "pred", N.STRIP))

    return [
        ("boxed", by(X.last_boxed, grading.judge_string)),
        ("pattern", by(lambda t: X.by_pattern(t, "The answer is: (.+)$"), grading.judge_string)),
        ("grade", cascade_judge),
    ]


JUDGED = f"""judged as (select id, gold, priority, form, case when form = 1 then 'pattern' when form <> 3 or {CLOSE_7} then 'boxed' end as judge from responses)"""


REWARD_LIST = {"accuracy": 1.0, "similarity": 0.5, "format": 0.25, "three_way": 0.1, "process": 0.2, "single_box": 0.0}


@query("reward_list", f"""with {fx.RESPONSES}, r as (select id, cast(case when form = 3 and not ({CLOSE_7}) then 0 else 1 end as double) as r_accuracy,
  cast(case when form in (0, 4) then 1 else 0 end as double) as r_similarity, cast(case when form = 1 then 0 else 1 end as double) as r_format,
  cast(case form when 1 then -1 when 3 then case when {CLOSE_7} then 1 else -0.5 end else 1 end as double) as r_three_way,
  1.0::double as r_process, cast(case when form in (1, 4) then 0 else 1 end as double) as r_single_box from responses)
select *, round(r_accuracy + 0.5 * r_similarity + 0.25 * r_format + 0.1 * r_three_way + 0.2 * r_process, 6) as reward from r""")
def reward_list(spark, sf):
    """All rewards by name; the solution of a response is its own thinking part."""
    rows = fx.responses(spark, sf).select("id", "response", "gold", X.thinking(F.col("response")).alias("solution"))
    return scoring.score(rows, REWARD_LIST).withColumn("reward", F.round("reward", 6))


@query("judge_cascade", f"""with {fx.RESPONSES}, {JUDGED}, d as (select distinct r.response, r.gold, j.judge from responses r join judged j using (id))
select coalesce(judge, 'none') as judge, count(*) as n_pairs from d group by 1""")
def judge_cascade(spark, sf):
    decided = grading.cascade(fx.responses(spark, sf), ["response", "gold"], judges())
    return decided.groupBy(F.coalesce("judge", F.lit("none")).alias("judge")).agg(F.count(F.lit(1)).alias("n_pairs"))


#: Response, gold answer, and the judge that accepts by profile (default, olympiad, multilingual), or who could not decide.
GRADE_FORMS = [
    (r"<think>t</think>The total is \boxed{@g}", "@g", ["boxed"] * 3, [None] * 3),
    ("The answer is: @g", "@g", ["pattern"] * 3, [None] * 3),
    (r"\boxed{x=@g}", "@g", ["symbolic"] * 3, [None] * 3),
    (r"It sums up: \boxed{1+2+@d}", "@d+3", ["boxed"] * 3, [None] * 3),
    (r"\boxed{@2g}", "@g", [None] * 3, [None] * 3),
    (r"\boxed{the set of all @d-cycles}", "@d", [None] * 3, ["boxed"] * 3),
    (r"\boxed{4x+6=@2g}", "2x+3=@g", [None, "olympiad", None], ["boxed", None, "boxed"]),
    (r"\boxed{(C) @g}", "C", [None, None, "multilingual"], [None] * 3),
    ("no idea", "@g", [None] * 3, [None] * 3),
    (r"first \boxed{@d} then \boxed{(x+@d)^2}", r"x^2+2*@d*x+@d*@d", ["boxed"] * 3, [None] * 3),
    (r"\boxed{@d} or \boxed{@7g}", "@7g,@d", [None, "olympiad", None], [None] * 3),
]
PROFILE_OF = {"1-URGENT": "olympiad", "2-HIGH": "multilingual"}


def _by_profile(column: int) -> str:
    """SQL for what a form gives under the profile of an order's priority."""
    def quoted(v):
        return "null" if v is None else f"'{v}'"

    branches = []
    for i, form in enumerate(GRADE_FORMS):
        default, olympiad, multilingual = map(quoted, form[column])
        branches.append(f"when {i} then case o_orderpriority when '1-URGENT' then {olympiad} when '2-HIGH' then {multilingual} else {default} end")
    return f"cast(case cast(o_orderkey % {len(GRADE_FORMS)} as int) {' '.join(branches)} end as varchar)"


@query("grade_responses", f"""select o_orderkey as id, {_by_profile(2)} as judge, {_by_profile(2)} is not null as correct,
{_by_profile(3)} as undecided from orders""")
def grade_responses(spark, sf):
    """Each order's priority stands for a data set and names the cascade its response is graded by."""
    orders = fx.texts(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("id"), fx.fill(fx.choose([f[0] for f in GRADE_FORMS], key)).alias("response"),
        fx.fill(fx.choose([f[1] for f in GRADE_FORMS], key)).alias("gold"), "o_orderpriority")
    names = F.create_map(*[F.lit(x) for kv in PROFILE_OF.items() for x in kv])
    profile = F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("default"))
    return grading.grade(rows, ["id"], profile=profile)


def graded_pairs(spark, sf, cases, judge):
    graded = grading.on_distinct_pairs(pair_forms(spark, sf, cases), ["pred", "gold"], judge)
    return graded.select("id", F.col("correct").alias("equal"))


MULTILINGUAL_PAIRS = [
    ("(C)", "C", True), ("C", "B", False), (r"@g\%", "@g", True), ("0.@d", r"@d0\%", True), ("1,@d00", "1@d00", True),
    (r"\left(@d,\frac{1}{2}\right)", "(@d, 0.5)", True), ("(@d,(1,2))", "(@d,(1,2.0))", True), ("(@d,1)", "(1,@d)", False),
    (r"\{1,@d\}", r"\{@d.0,1\}", True), (r"\{1,1,@d\}", r"\{1,@d,@d\}", False),
    (r"\begin{bmatrix}1&@d\\2&3\end{bmatrix}", r"\begin{pmatrix}1.0&@d\\2&\frac{6}{2}\end{pmatrix}", True),
    (r"\begin{pmatrix}1\\@d\end{pmatrix}", "{1,@d}", True), (r"(0,1)\cup(2,@g)", r"(0,1.0)\cup(2,@g)", True),
    ("2k+3=@g", "-2k-3=-@g", True), ("k=@g", "@g", True), ("2k+3=@g", "k=@g", False), ("x+@d", "@d+x", True), (r"\sqrt{8}", r"2\sqrt{2}", True),
    ("twelve", "12", True), ("@d miles", "@d", True), ("some words", "@g", False), (r"2\frac{1}{3}", "5", None), ("@g", "@2g", False),
    ("", "@g", False), (r"(x+@d)^2", r"x^2+2*@d*x+@d*@d", True), (r"\{1.00015,1.00007\}", r"\{1.0001,1.0002\}", True),
]


@query("grade_multilingual", pair_truth(MULTILINGUAL_PAIRS))
def grade_multilingual(spark, sf):
    return graded_pairs(spark, sf, MULTILINGUAL_PAIRS, grading.judge_multilingual)


SYMBOLIC_PAIRS = [
    (r"\{1,0.5,@g\}", r"\{@g,\frac{1}{2},1\}", True), (r"\{1,@d\}", r"\{1,1,@d\}", True), (r"\{1,2,@g\}", r"\{1,@g\}", False),
    ("(@d,1/2)", "(@d,0.5)", True), ("(1,@d)", "[@d,1]", False), ("2024-01-0@d", "2024/01/0@d", True), ("Yes", "True", True), ("Tues", "Wed", False),
    (r"\begin{pmatrix}1\\@d\end{pmatrix}", "(1,@d)", True), (r"\begin{pmatrix}1&2\\3&@d\end{pmatrix}", r"\begin{bmatrix}1&2\\3&@d.0\end{bmatrix}", True),
    ("x=@g", "@g", True), ("y+x=@g", "x+y-@g=0", True), (r"\frac{@2g}{2}", "@g", True), ("0.25", r"25\%", True), ("@g", "@7g", False),
    (r"\sin^2 x+\cos^2 x", "1", True), ("@d cm", "@d", True), (r"(0,1)\cup(2,@g)", r"(0,1)\cup(2,@g.0)", True), ("1.0000000001,@d", "1,@d", True),
    (r"5!", "120", True), (r"@d\oplus 3", "@g", None), ("", "@g", False),
]


@query("grade_symbolic", pair_truth(SYMBOLIC_PAIRS))
def grade_symbolic(spark, sf):
    return graded_pairs(spark, sf, SYMBOLIC_PAIRS, grading.judge_symbolic)


OLYMPIAD_PAIRS = [
    (r"\boxed{x=2}", "2", True), (r"\boxed{x=1/2}", "0.5", True), (r"\boxed{2x+3=7}", "-2x-3=-7", True), (r"\boxed{x=@d}", "y=@d", False),
    (r"\boxed{@g} and \boxed{@d}", "@d,@g", True), (r"\boxed{1\pm\sqrt{@d}}", r"1-\sqrt{@d},1+\sqrt{@d}", True), (r"\boxed{(0,@d]}", r"(0,@d.0]", True),
    (r"\boxed{(0,@d]}", "(0,@d)", False), (r"$@g\%$", "@g", None), (r"\boxed{@g.00000001}", "@g", True), (r"\boxed{@g.0001}", "@g", False),
    (r"\boxed{2\pi}", "6.283185307179586", True), (r"\boxed{y=x+@d}", "2y=2x+2*@d", True), (r"\boxed{\frac{1}{x}+1}", r"\frac{x+1}{x}", True),
    ("The last line\n$@d$ or $@g$", "@g,@d", True), (r"\boxed{@d,@d}", "@d", False), (r"\boxed{x^2=@d}", "x=@d", False),
]


@query("grade_olympiad", pair_truth(OLYMPIAD_PAIRS))
def grade_olympiad(spark, sf):
    return graded_pairs(spark, sf, OLYMPIAD_PAIRS, grading.judge_olympiad)
