"""Answer normalisation profiles.

A profile is an ordered list of steps over one text column. A step is a literal replacement, a regular
expression replacement, or a function of the column. :func:`run` lays the steps out as projections: steps that
use their input once are chained into one expression; a step that uses it several times reads the column
produced before it, so no expression is ever evaluated twice.

Fixed values: the literals and patterns listed in the profiles below and the order in which they apply.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import rules
from veritrace.functions.text import (
    clean_edges, closing_length, has, last, let, quote, rstrip, strip, truth_word,
)

Step = tuple[str, str, str] | Callable[[Column], Column]
NUMBER_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def lit(old: str, new: str = "") -> Step:
    return ("literal", old, new)


def sub(pattern: str, new: str = "") -> Step:
    return ("pattern", pattern, new)


def run(df: DataFrame, source: str, target: str, steps: list[Step]) -> DataFrame:
    """Apply a profile to ``source`` and put the canonical text in ``target``."""
    current, plain = F.col(source), True
    for step in steps:
        if callable(step):
            if not plain:
                df, current = df.withColumn(target, current), F.col(target)
            current = step(current)
        else:
            current = chain(current, [step])
        plain = False
    return df.withColumn(target, current)


def chain(column: Column, steps: list[Step]) -> Column:
    """Literal and pattern steps as one expression."""
    for kind, old, new in steps:
        column = F.replace(column, F.lit(old), F.lit(new)) if kind == "literal" else F.regexp_replace(column, old, new)
    return column


def only_if(pattern: str, steps: list[Step]) -> Step:
    """A run of steps none of which can act on a text without ``pattern``; other texts skip the whole run."""
    return lambda s: F.when(s.rlike(pattern), chain(s, steps)).otherwise(s)


_ORDINARY = frozenset(string.ascii_letters + string.digits + " +-*/^=(),.")


def literals(steps: list[Step]) -> Step:
    """A run of literal replacements; texts that hold a mark of none of them skip the whole run.

    The mark of a literal is its first sign that plain formulas do not have, else the literal itself.
    """
    old = [step[1] for step in steps]
    marks = [next((c for c in text if c not in _ORDINARY), None) for text in old]
    signs = "".join(rf"\x{{{ord(c):x}}}" for c in dict.fromkeys(c for c in marks if c))
    words = [quote(text) for text, mark in zip(old, marks, strict=True) if mark is None]
    return only_if("|".join([f"[{signs}]", *words]) if signs else "|".join(words), steps)


def to_number(text: Column) -> Column:
    """Double value of a plain decimal number, NULL otherwise."""
    return F.when(text.rlike(NUMBER_TEXT), strip(text).try_cast("double"))


# A comma between digit groups: three digits follow, then no further digit.
GROUP_COMMA = r"(?<=\d),(?=\d{3}(?!\d))"


def _digits(value: Column) -> Column:
    """All digits of a whole double, however many there are."""
    return F.coalesce(value.try_cast("decimal(38,0)").cast("string"), F.format_string("%.0f", value))


def integer_text(s: Column) -> Column:
    """Whole numbers, with or without group commas, become plain integers."""
    value = to_number(F.regexp_replace(s, GROUP_COMMA, ""))
    return F.when(F.abs(value - F.rint(value)) <= 1e-7, _digits(value)).otherwise(s)


def whole(s: Column) -> Column:
    return F.coalesce(integer_text(s), s)


def brace_fracs(s: Column) -> Column:
    r"""Give ``\frac`` arguments their braces; a text with a ``\frac`` too short to repair stays as it is."""
    repaired = F.regexp_replace(s, r"(?s)\\frac([^{])\{", r"\\frac{$1}{")
    repaired = F.regexp_replace(repaired, r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    return F.when(~has(s, r"\frac") | s.rlike(r"(?s)\\frac(?!\{).?(?:\\frac|\z)"), s).otherwise(repaired)


def slash_to_frac(with_sqrt: bool) -> Step:
    whole_number = r"0|-?[1-9]\d*"
    side = rf"{whole_number}|[^/]*sqrt[^/]*" if with_sqrt else whole_number
    return sub(rf"(?s)^({side})/({side})$", r"\\frac{$1}{$2}")


def keep_right(max_left: int) -> Callable[[Column], Column]:
    """``x=value`` keeps the value when there is one sign and a short left side."""
    def step(s: Column) -> Column:
        return F.when(has(s, "="), let(F.split(s, "=", -1), lambda p: F.when(
            (F.size(p) == 2) & (F.length(p[0]) <= max_left), F.element_at(p, 2)).otherwise(s))).otherwise(s)
    return step


def unless_empty(pattern: str) -> Callable[[Column], Column]:
    """Remove a pattern and trim, unless nothing would remain."""
    def step(s: Column) -> Column:
        return let(strip(F.regexp_replace(s, pattern, "")), lambda r: F.when(r != "", r).otherwise(s))
    return step


def leading_zero(s: Column) -> Column:
    return F.regexp_replace(s, r"^\.", "0.")


def imaginary(s: Column) -> Column:
    return F.when(has(s, "j") & ~has(s, "i"), F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)


def infinity(s: Column) -> Column:
    return F.when(has(s, r"\infty"), s).otherwise(F.replace(s, F.lit("inf"), F.lit(r"\infty")))


def _unit_steps(units: list[str]) -> Step:
    """Units begin with a letter: texts without any are not searched for them."""
    removed = [sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?") for unit in units]
    return lambda s: F.when(s.rlike("[a-zA-Z]") & s.rlike("|".join(units)), chain(s, removed)).otherwise(s)


# ---------------------------------------------------------------- profile "string"

def _cut_units(s: Column) -> Column:
    parts = F.split(s, r"\\text\s*\{\s*", -1)
    boxes = F.split(s, r"\\mbox\{", -1)
    rest = (
        F.when(has(s, r"\text{"), F.regexp_replace(s, r"\\text\{([^}]+)\}", "$1"))
        .when(has(s, r"\mbox{"), let(boxes, lambda b: F.when(F.size(b) == 2, b[0]).otherwise(s)))
        .otherwise(s)
    )
    return F.when(has(s, r"\text"), let(parts, lambda p: F.when(
        (F.size(p) == 2) & ~p[0].isin("", "("), p[0]).otherwise(rest))).otherwise(rest)


def _after_in(s: Column) -> Column:
    return F.when(has(s, "\\in "), strip(F.element_at(F.split(s, quote("\\in "), -1), 2))).otherwise(s)


def _drop_day(s: Column) -> Column:
    named = s.rlike("|".join(rules.WEEKDAYS))
    return F.when(has(s, "day") & ~named, F.regexp_replace(s, "days?", "")).otherwise(s)


def strip_currency(s: Column) -> Column:
    """A leading ``$`` before a number goes; a pure percentage loses its sign."""
    return (
        F.when(s.rlike(r"^\$\d+(\.\d+)?"), F.substring(s, F.lit(2), F.length(s)))
        .when(s.rlike(r"^\d+(\.\d+)?\\?%$"), F.regexp_replace(s, r"\\?%", ""))
        .otherwise(s)
    )


STRING: list[Step] = [
    only_if(r"\\", [lit(r"\left"), lit(r"\right"), sub(r"\s*\\text\{\s*(or|and)\s*\}\s*", ",")]), sub(r",\s*,", ","),
    _cut_units, _after_in,
    only_if(r"\\", [
        step for name in ("text", "mathrm", "mathcal", "textbf", "textit")
        for step in (lit(rf"\\{name}"), sub(rf"^\\{name}\{{(.+?)\}}$", "$1"))
    ]),
    literals([
        lit(r"\!"), lit(r"\%", "%"), lit(r"\$", "$"), lit("$"), lit("%"), lit(r"^{\circ}"),
        lit(" or ", " , "), lit(" and ", " , "),
        *[lit(word, power) for word, power in rules.MAGNITUDES.items()],
    ]),
    _unit_steps(rules.STRING_UNITS),
    _drop_day,
    only_if(r"[\\{]", [
        sub(r"\^ *\\\\circ"),
        sub(r"(?s)^\{(.*)\}$", "$1"),
        sub(r"(?U)\\sqrt(\s*\w+)", r"\\sqrt{$1}"),
        sub(r"\\frac +", r"\\frac"),
    ]),
    brace_fracs,
    only_if(r"[ \\]", [
        sub("- *", "-"), sub("([0-9]) +([0-9])", "$1+$2"),
        sub(r"(\d+) *\\frac\{(\d+)\}\{(\d+)\}", "$1 + $2/$3"),
        lit(" "),
    ]),
    whole,
]

# ---------------------------------------------------------------- profile "strip"

STRIP: list[Step] = [
    strip, lit("\n"), lambda s: rstrip(s, "."),
    only_if(r"\\|[tdc]frac", [
        lit(r"\!"), sub(r"(?s)^\\text\{(.*)\}$", "$1"),
        lit("tfrac", "frac"), lit("dfrac", "frac"), lit("cfrac", "frac"), lit(r"\left"), lit(r"\right"),
    ]),
    unless_empty(r"\\text\{.*?\}$"),
    lit(r"^{\circ}"), strip, lit(r"^\circ"), strip,
    sub(r"\{(c|m)?m\}(\^(2|3))?"), strip, sub(r"p\.m\.$"), strip, sub(r"(\d)\s*t$", "$1"), strip,
    literals([
        lit(r"\$"), lit("$"), lit(r"x\in"), lit(r"\%", "%"), lit(" .", " 0."), lit("{.", "{0."), lit(r"\cdot"),
        lit("infinity", r"\infty"),
    ]),
    infinity,
    only_if("[\\\\'\"]", [
        lit(r"+\inity", r"\infty"), lit(r"\mathbf"), lit(r"\mathrm"), sub(r"\\mbox\{.*?\}"), lit("'"), lit('"'),
    ]),
    imaginary,
    sub(r"(\d+)\.0+([^\d])", "$1$2"), sub(r"(\d+)\.0+$", "$1"),
    leading_zero,
    only_if(r"\\", [
        sub(r"\\sqrt(-?[0-9.a-zA-Z]+)", r"\\sqrt{$1}"), sub(r"(?U)\\sqrt\s+(\w+)$", r"\\sqrt{$1}"),
        sub(r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}"), sub(r"(?U)\\tan\s+(\w+)$", r"\\tan{$1}"),
    ]),
    lit(" "), brace_fracs, slash_to_frac(with_sqrt=True), sub(r"(\\|,|\.)+$"),
]

# ---------------------------------------------------------------- profiles "mathd" and "grade"

MATHD: list[Step] = [
    strip, sub(r"(?d)^\\text\{(.+?)\}$", "$1"), strip,
    only_if(r"[\n\\ {]|[td]frac", [
        lit("\n"), lit(r"\!"), lit("\\\\", "\\"), lit("tfrac", "frac"), lit("dfrac", "frac"), lit(r"\left"), lit(r"\right"),
        lit(r"^{\circ}"), lit(r"^\circ"), lit(r"\$"), sub(r"(?s)\\text\{ .*"), lit(r"\%"),
        lit(" .", " 0."), lit("{.", "{0."),
    ]),
    leading_zero, keep_right(2),
    only_if(r"[\\ ]", [sub(r"(?s)\\sqrt([^{])", r"\\sqrt{$1}"), lit(" ")]), brace_fracs,
    sub(r"^0\.5$", r"\\frac{1}{2}"), slash_to_frac(with_sqrt=False),
]


def _plain_if_latex(s: Column) -> Column:
    """LaTeX to plain arithmetic for texts that contain a backslash."""
    plain = s
    for old, new in [(r"\tfrac", r"\frac"), (r"\dfrac", r"\frac"), (r"\frac", r" \frac")]:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    for pattern, new in [
        (r"\\frac\{([^}]*)\}\{([^}]*)\}", "(($1)/($2))"), (r"\\sqrt\{([^}]*)\}", "sqrt($1)"),
        (r"\\sqrt([0-9])", "sqrt($1)"), (r"\\(?:text|mathrm|mathbf)\{([^}]*)\}", "$1"),
    ]:
        plain = F.regexp_replace(plain, pattern, new)
    for old, new in [(r"\pi", "pi"), (r"\infty", "inf"), (r"\cdot", "*"), (r"\times", "*"), (r"\div", "/")]:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\^\{([^}]*)\}", "**($1)"), r"\{([^}]*)\}", "($1)")
    for old, new in [("\\", ""), ("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*")]:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.when(has(s, "\\"), strip(plain)).otherwise(s)


def _round_number(s: Column) -> Column:
    return let(to_number(s), lambda v: F.when(
        F.abs(v - F.rint(v)) <= 1e-7, _digits(v)).otherwise(s))


GRADE: list[Step] = [
    sub(r"(?d)^\\text\{(.+?)\}$", "$1"),
    literals([
        lit(r"\%", "%"), lit(r"\$", "$"), lit("$"), lit("%"),
        lit(" or ", " , "), lit(" and ", " , "),
        *[lit(word, power) for word, power in rules.MAGNITUDES.items()],
    ]),
    _unit_steps(rules.GRADE_UNITS),
    only_if(r"[\\{]", [sub(r"\^ *\\circ"), sub(r"(?s)^\{(.*)\}$", "$1"), sub(r",\\! *")]),
    _round_number, _plain_if_latex,
    only_if("[ {}]", [sub("- *", "-"), sub("([0-9]) +([0-9])", "$1+$2"), lit(" "), lit("{"), lit("}")]), F.lower,
    whole,
]

# ---------------------------------------------------------------- profile "multilingual strip"

# Units are removed one by one in the published order, plurals last, each as a pattern in which a dot is any character.
_UNITS = [u + s for s in ("", "s") for u in rules.MULTILINGUAL_UNITS]
_ANY_UNIT = rf"(?U)(^|\W)(?:{'|'.join(_UNITS)})($|\W)"


def _drop_units(s: Column) -> Column:
    """One pass over the units; a removal that would empty the text is left out.

    Only units whose first word is a word of the text are tried: what stays beside a removal is bounded by non-word
    characters, so no removal makes a new word.
    """
    units = F.array(*[F.struct(
        F.lit(re.search(r"\w+", u)[0]).alias("start"), F.lit(rf"(?U)(^|\W){u}($|\W)").alias("pattern")) for u in _UNITS])

    def drop_one(text: Column, unit: Column) -> Column:
        return let(F.regexp_replace(text, unit["pattern"], F.lit("$1$2")), lambda r: F.when(r != "", r).otherwise(text))

    def drop_present(text: Column, words: Column) -> Column:
        present = F.filter(units, lambda u: F.array_contains(words, u["start"]))
        return F.aggregate(present, text, drop_one)

    dropped = let(F.split(s, r"(?U)\W+", -1), lambda words: drop_present(s, words))
    return F.when(s.rlike(_ANY_UNIT), dropped).otherwise(s)


def _number_pattern() -> str:
    """Well-formed number words: hundreds by scale, largest first, then digits after "point"."""
    def named(low: int, high: int) -> str:
        return f"(?:{'|'.join(w for w, v in rules.NUMBER_WORDS.items() if low <= v <= high)})"

    gap, below_100 = "[ -]+(?:and )?", rf"(?:{named(20, 90)}(?:[ -]+{named(1, 9)})?|{named(1, 19)})"
    below_1000 = rf"(?:(?:{named(1, 9)}[ -]+)?hundred(?:{gap}{below_100})?|{below_100})"
    scales = [w for w, v in sorted(rules.NUMBER_SCALES.items(), key=lambda kv: -kv[1]) if v > 100]
    parts, tail = [], below_1000
    for i in range(len(scales)):  # begins with any scale, and goes on with smaller ones
        rest = "".join(rf"(?:{gap}{below_1000}[ -]+{w})?" for w in scales[i + 1:])
        parts.append(rf"{below_1000}[ -]+{scales[i]}{rest}(?:{gap}{below_1000})?")
    whole_number = "|".join([*parts, tail, *rules.NUMBER_SCALES])
    return rf"(?i)^(?:{whole_number})(?:[ -]+point(?:[ -]+{named(1, 9)})+)?$"


_NUMBER_TEXT = _number_pattern()


def word_number(s: Column) -> Column:
    """A well-formed number in words, blanks, hyphens and "and" between them, becomes its value; other texts stay.

    Words that form no number ("one two three", "hundred hundred") stay a text. Below a thousand billion, nothing overflows.
    """
    words = F.create_map(*[F.lit(x) for kv in rules.NUMBER_WORDS.items() for x in kv])
    scales = F.create_map(*[F.lit(x) for kv in rules.NUMBER_SCALES.items() for x in kv])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"))

    def step(acc: Column, word: Column) -> Column:
        scale, value = F.try_element_at(scales, word), F.try_element_at(words, word)
        scaled = F.greatest(acc["part"], F.lit(1).cast("long")) * scale
        return F.struct(
            (acc["total"] + F.when(scale > 100, scaled).otherwise(F.lit(0))).cast("long").alias("total"),
            F.when(scale > 100, F.lit(0)).when(scale == 100, scaled).otherwise(acc["part"] + F.coalesce(value, F.lit(0)))
            .cast("long").alias("part"))

    low = F.lower(s)
    value = F.aggregate(
        F.split(F.substring_index(low, "point", 1), "[ -]+", -1), start, step, lambda acc: acc["total"] + acc["part"]).cast("string")
    digits = F.array_join(F.transform(
        F.filter(F.split(F.substring_index(low, "point", -1), "[ -]+", -1), lambda w: w != ""),
        lambda w: F.try_element_at(words, w).cast("string")), "")
    number = F.when(has(low, "point"), F.concat(value, F.lit("."), digits)).otherwise(value)
    return F.when(s.rlike("[a-zA-Z]") & s.rlike(_NUMBER_TEXT), number).otherwise(s)


def multilingual(skip_unit: bool = False) -> list[Step]:
    return [
        strip, lit("\n"), lambda s: rstrip(s, "."), lit(r"\!"),
        sub(r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"), sub(r"\\end\{array\}", r"\\end{pmatrix}"),
        lit("bmatrix", "pmatrix"), lit("tfrac", "frac"), lit("dfrac", "frac"),
        lit(r"\neq", r"\ne"), lit(r"\leq", r"\le"), lit(r"\geq", r"\ge"),
        lit(r"\left"), lit(r"\right"), lit(r"\{", "{"), lit(r"\}", "}"),
        unless_empty(r"\\text\{.*?\}$"),
        *([] if skip_unit else [_drop_units, _drop_units]),
        lit(r"^{\circ}"), lit(r"^\circ"), lit(r"\$"), lit("$"), lit(r"\("), lit(r"\)"),
        word_number, sub(r"\\text\{(.*?)\}", "$1"),
        *[lit(p) for p in ("x=", "y=", "z=", r"x\in", r"y\in", r"z\in", r"x\to", r"y\to", r"z\to")],
        lit(r"\emptyset", "{}"), lit(r"(-\infty,\infty)", r"\mathbb{R}"), lit(r"\%"), lit("%"),
        lit(" .", " 0."), lit("{.", "{0."), lit("infinity", r"\infty"), infinity, lit(r"+\inity", r"\infty"),
        lit("and"), lit(r"\mathbf"), sub(r"\\mbox\{.*?\}"), imaginary,
        sub(r"(\d+)\.0*([^\d])", "$1$2"), sub(r"(\d+)\.0*$", "$1"),
        leading_zero, keep_right(2), sub(r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}"), lit(" "),
        brace_fracs, slash_to_frac(with_sqrt=True),
    ]


# ---------------------------------------------------------------- profile "symbolic"

_PAIRS = [(r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), ("(", ")"), ("[", "]"), ("{", "}")]


def _closes_at(s: Column, pair: Column) -> Column:
    """1-based start of the bracket that closes the one at the very start; 0 when none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(acc: Column, token: Column) -> Column:
        change = F.when(token.endswith(pair["left"]), 1).when(token == pair["right"], -1).otherwise(0)
        depth = acc["depth"] + change
        closing = (change == -1) & (depth == 0)
        return F.when(acc["at"] > 0, acc).otherwise(F.struct(
            depth.alias("depth"), (acc["used"] + F.length(token)).alias("used"),
            F.when(closing, acc["used"] + 1).otherwise(0).alias("at"),
        ))

    return F.aggregate(F.split(s, pair["cuts"], -1), start, step, lambda acc: acc["at"])


def out_parens(s: Column) -> Column:
    """Remove one layer of every bracket kind that encloses the whole text."""
    kinds = F.array(*[
        F.struct(
            F.lit(left).alias("left"), F.lit(right).alias("right"),
            F.lit(f"(?<={quote(left)})|(?={quote(right)})|(?<={quote(right)})").alias("cuts"),
        ) for left, right in _PAIRS
    ])

    def peel(text: Column, pair: Column) -> Column:
        size = F.length(pair["left"])
        encloses = _closes_at(text, pair) == F.length(text) - size + 1
        return F.when(text.startswith(pair["left"]), F.when(
            encloses, F.substring(text, size + 1, F.length(text) - 2 * size)).otherwise(text)).otherwise(text)

    return F.aggregate(kinds, s, peel)


def bare(s: Column) -> Column:
    """Without enclosing brackets, however many layers there are; texts that open no bracket are not examined."""
    layers = F.length(F.regexp_extract(s, r"^[\\(\[{]+", 0))
    peeled = F.aggregate(F.sequence(F.lit(1), layers), s, lambda inner, _: out_parens(inner))
    return F.when(s.rlike(r"^[\\(\[{]"), peeled).otherwise(s)


def _drop_command(s: Column, name: Column) -> Column:
    r"""Drop the first ``\name``; the braces of its argument, or of the group it opens, go with it."""
    def behind(text: Column, n: Column) -> Column:
        return F.substring(text, n + 1, F.length(text))

    def unwrap(head: Column, tail: Column) -> Column:
        argument = let(F.substring(tail, F.lit(2), F.length(tail)), lambda t: let(closing_length(t), lambda n: F.when(
            n > 0, F.concat(F.left(t, n - 1), behind(t, n))).otherwise(tail)))
        end = F.instr(tail, "}")
        group = F.concat(F.left(head, F.length(head) - 1), F.left(tail, end - 1), behind(tail, end))
        return (
            F.when(tail.startswith("{"), F.concat(head, argument))
            .when(head.endswith("{") & (end > 0), group)
            .otherwise(F.concat(head, tail))
        )

    def cut(text: Column) -> Column:
        at = F.instr(text, name)
        parts = let(strip(F.left(text, at - 1)), lambda head: let(
            strip(behind(text, at + F.length(name) - 1)), lambda tail: unwrap(head, tail)))
        return F.when(at > 0, parts).otherwise(text)

    return let(s, cut)


def _drop_commands(s: Column) -> Column:
    """Texts without any of the commands are not examined."""
    names = F.array(*[F.lit(c) for c in rules.SYMBOLIC_COMMANDS])
    named = has(s, "\\") & s.rlike("|".join(quote(c) for c in rules.SYMBOLIC_COMMANDS))
    return F.when(named, F.aggregate(names, s, _drop_command)).otherwise(s)


def is_set(s: Column) -> Column:
    """Whether a text is written as a set: in braces, or with "or" between its parts."""
    return s.rlike(r"[^a-z]or(x|[^a-z])") | s.rlike(r"(?s)^\{.*\}$") | s.rlike(r"(?s)^\\\{.*\\\}$")


def _set_members(s: Column) -> Column:
    """Members of a set without its brackets: distinct, sorted, joined by commas; other texts unchanged."""
    members = F.transform(F.split(F.replace(bare(s), F.lit("or"), F.lit(",")), ",", -1), strip)
    return F.when(is_set(s), F.array_join(F.array_sort(F.array_distinct(members)), ",")).otherwise(s)


def _right_side(s: Column) -> Column:
    """Value of an equality chain, of a named quantity, or of an equality without letters on its left."""
    def pick(p: Column) -> Column:
        left = strip(p[0])
        return (
            F.when(F.size(p) > 2, last(p))
            .when((F.size(p) == 2) & (left.rlike(rules.NAMED_LEFT_SIDE) | ~left.rlike("[a-zA-Z]")), last(p))
            .otherwise(F.array_join(p, "="))
        )

    return F.when(~has(s, "=") | has(s, r"\begin{array}"), s).otherwise(let(F.split(s, "=", -1), pick))


def _outside_if_single(s: Column) -> Column:
    return F.when(has(s, ","), s).otherwise(bare(s))


def _plus_minus(s: Column) -> Column:
    sides = rules.PLUS_MINUS_SIDES
    return F.when(has(s, r"\pm") | has(s, r"\mp"), let(bare(s), lambda o: F.when(
        o.rlike(sides), F.regexp_replace(o, sides, "$1-$2,$1+$2")).otherwise(s))).otherwise(s)


def _inequality(sign: str) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        many = F.size(F.split(s, sign, -1)) > 2
        return F.when(has(s, sign) & many & ~F.lower(s).rlike(",|and|or"), F.replace(s, F.lit(sign), F.lit(","))).otherwise(s)
    return step


def _double_backslash(s: Column) -> Column:
    return F.when(has(s, r"\begin{array}"), s).otherwise(F.replace(s, F.lit("\\\\"), F.lit("")))


def weekday(s: Column) -> Column:
    """Full weekday name of a single word that starts with its three-letter form, else NULL."""
    low = F.lower(strip(s))
    found = None
    for day in rules.WEEKDAYS:
        hit = low.startswith(day[:3].lower()) & ~has(low, " ")
        found = F.when(hit, day) if found is None else found.when(hit, day)
    return found


def word_answer(s: Column) -> Column:
    """``True``, ``False`` or a weekday; NULL for anything else."""
    return F.coalesce(truth_word(s), weekday(s))


SYMBOLIC: list[Step] = [
    lit("\n"), strip, clean_edges,
    literals([*[lit(t) for t in rules.SYMBOLIC_REMOVE], *[lit(a, b) for a, b in rules.SYMBOLIC_REPLACE]]),
    infinity, lit(" "),
    _drop_commands,
    only_if(r"\\(begin|end)", [
        lit(rf"\{edge}{{{env}}}") for env in rules.SYMBOLIC_ENVIRONMENTS for edge in ("begin", "end")
    ]),
    lit("rad"), only_if("circ", [sub(r"^(\d+) ?\^?\\?circ$", "$1"), sub(r"(\d+) ?\^?\\?circ", r"{$1*\\frac{\\pi}{180}}")]),
    # The beginnings of all function names: few texts go on to the patterns that try each name at each place.
    only_if("pi|[sctle](?:in|ec|os|ot|sc|an|og|n|xp)", [
        sub(rf"(?<!\\)(pi\b|{rules.FUNCTION_NAMES})", r"\\$1"),
        sub(rf"\\?({rules.FUNCTION_NAMES})\^(\d+)", r"\\$1^{$2}"),
        sub(rf"\\?({rules.FUNCTION_NAMES})(?!\^)", r"\\$1^{1}"),
    ]),
    only_if(r"\{", [sub(r"\{[a-z]?matrix\}", "{array}"), sub(r"\\begin\{array\}\{[lcr]*\}", r"\\begin{array}{}")]),
    _double_backslash, imaginary,
    sub(r"(\d+)\.0+([^\d])", "$1$2"), sub(r"(\d+)\.0+$", "$1"),
    only_if(  # every unit begins with a letter, so the units are tried only behind a number that a letter follows
        rf"[-\d\.\*\^{{}}](?=[a-zA-Zμ])(?:{'|'.join(rules.SYMBOLIC_UNITS)})",
        [sub(rf"(?s)([-\d\.\*\^{{}}]+){unit}e?s?.*", "$1") for unit in rules.SYMBOLIC_UNITS],
    ),
    leading_zero, _set_members,
    only_if("sqrt", [sub(r"\\?sqrt[\(\{\[](\w+)[\)\}\]]", r"\\sqrt{$1}"), sub(r"\\?sqrt\s*(\d+)", r"\\sqrt{$1}")]),
    sub("(^|,)frac", r"$1\\frac"), brace_fracs,
    sub(r"(\b\d+|sqrt\(.*?\))/(\d+|sqrt\(.*?\)\b)", r"\\frac{$1}{$2}"),
    sub(r"^[a-z]\\in"), _outside_if_single, _right_side, _plus_minus, sub(r"^0+([1-9])", "$1"),
    _outside_if_single, word_number, sub(r"\\mid([a-z])", r"\\mid $1"), clean_edges,
    _inequality("<"), _inequality(">"),
]


def symbolic(df: DataFrame, source: str, target: str) -> DataFrame:
    """Words (truth values, weekdays) win; every other answer goes through the symbolic profile."""
    df = run(df, source, target, SYMBOLIC)
    word = word_answer(clean_edges(F.replace(F.col(source), F.lit("\n"), F.lit(""))))
    word = F.when(F.col(source).rlike("[a-zA-Z]"), word)  # no word is without a letter
    return df.withColumn(target, F.coalesce(word, F.col(target)))


# ---------------------------------------------------------------- profile "olympiad"

def olympiad_text(text: Column) -> Column:
    """All boxes, else the formulas of the last line, else the whole text; each item ends with a comma."""
    from veritrace.functions.text import all_boxed

    def items(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(","))), "")

    formulas = F.regexp_extract_all(F.substring_index(strip(text), "\n", -1), F.lit(r"\$(.*?)\$"), 1)
    boxes = all_boxed(text, opener=r"\boxed{")
    n_boxes = F.size(F.split(text, r"\\boxed\{", -1)) - 1
    return let(boxes, lambda b: (
        F.when(n_boxes > F.size(b), F.lit(None).cast("string"))
        .when(F.size(b) > 0, items(b))
        .otherwise(let(formulas, lambda f: F.when(F.size(f) > 0, items(f)).otherwise(text)))
    ))


def _olympiad_in(s: Column) -> Column:
    return F.when(has(s, "\\in "), F.element_at(F.split(s, quote("\\in "), -1), 2)).otherwise(s)


OLYMPIAD: list[Step] = [
    olympiad_text, _olympiad_in,
    *[lit(a, b) for a, b in rules.OLYMPIAD_SYMBOLS],
    lambda s: F.trim(s, F.lit(rules.OLYMPIAD_EDGES)),
    sub(r"\\(?:mathrm|mathbf)\{~?([^}]*)\}", "$1"),
]
CJK = r"[\u4e00-\u9fff]+"
