"""Equality of answers: tolerance profiles, closed forms, tuples, sets, intervals, matrices and equations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrace.functions import rules
from veritrace.functions.normalize import GROUP_COMMA, to_number
from veritrace.functions.text import has, let, strip


@dataclass(frozen=True)
class Tolerance:
    """``|a-b| <= max(rel*max(|a|,|b|), abs)``; ``percent`` also accepts the gold value over and times 100."""

    rel: float
    abs: float
    percent: bool = True
    percent_range_only: bool = False
    percent_rel: float | None = None


# Tolerance of each grading profile.
TOLERANCES = {
    "string": Tolerance(rel=1e-4, abs=0.0),
    "minerva": Tolerance(rel=1e-9, abs=1e-3),
    "olympiad": Tolerance(rel=0.0, abs=1e-8 * 1.01),
    "symbolic": Tolerance(rel=1e-9, abs=1e-8, percent_range_only=True, percent_rel=1e-3),
    "multilingual": Tolerance(rel=1e-4, abs=0.0, percent_range_only=True, percent_rel=1e-4),
}


def is_close(a: Column, b: Column, rel: float, abs_tol: float) -> Column:
    bound = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return F.abs(a - b) <= bound


def numeric_equal(pred: Column, gold: Column, profile: str = "string") -> Column:
    """Equality of two doubles under a tolerance profile; NULL when either is NULL."""
    tol = TOLERANCES[profile]
    equal = is_close(gold, pred, tol.rel, tol.abs)
    if not tol.percent:
        return equal
    rel = tol.rel if tol.percent_rel is None else tol.percent_rel

    def could_be_percent(v: Column) -> Column:
        return ((v > 0) & (v < 1)) | ((v > 1) & (v < 100))

    for other in (gold / 100, gold * 100):
        hit = is_close(other, pred, rel, tol.abs)
        if tol.percent_range_only:
            hit = hit & could_be_percent(pred) & could_be_percent(other)
        equal = equal | hit
    return equal


def parse_number(text: Column, percent: bool = True) -> Column:
    r"""Number without its commas (plain or ``{,}``); a trailing ``%`` or ``\%`` divides by 100."""
    plain = F.regexp_replace(text, r"\{,\}|,", "")
    value = to_number(plain)
    if not percent:
        return value
    return F.coalesce(value, to_number(F.regexp_replace(plain, r"\\?%$", "")) / 100)


# ------------------------------------------------------------------ closed forms

_SIGNED = r"[-+]?\d+(?:\.\d+)?"
_PARTS = {
    "number": rf"^\(*({_SIGNED})\)*$",
    "ratio": rf"^\(*({_SIGNED})\)*/\(*({_SIGNED})\)*$",
    "latex ratio": rf"^(-?)\\frac\{{({_SIGNED})\}}\{{({_SIGNED})\}}$",
    "mixed": r"^(-?\d+)\+(\d+)/(\d+)$",
    "root": r"^(-?\d*\.?\d*)\*?(?:\\sqrt\{(\d+(?:\.\d+)?)\}|sqrt\((\d+(?:\.\d+)?)\))$",
    "pi": r"^(-?\d*\.?\d*)\*?\\?pi$",
    "root ratio": r"^(-?)\\frac\{(\d*\.?\d*)\\sqrt\{(\d+(?:\.\d+)?)\}\}\{(\d+(?:\.\d+)?)\}$",
    "sum": rf"^({_SIGNED})([+-]\d+(?:\.\d+)?)$",
    "product": rf"^({_SIGNED})\*({_SIGNED})$",
    "power": r"^(\d+(?:\.\d+)?)\^\{?(-?\d+)\}?$",
    "scaled power": rf"^({_SIGNED})\*(\d+(?:\.\d+)?)\^\{{?(-?\d+)\}}?$",
    "pi ratio": r"^(-?)\\frac\{(\d*\.?\d*)\*?\\pi\}\{(\d+(?:\.\d+)?)\}$",
}


def closed_form(text: Column) -> Column:
    r"""Value of ``a``, ``a/b``, ``\frac{a}{b}``, ``a+b/c``, ``a+b``, ``a*b``, ``a^n``, ``a*b^n``, ``c\sqrt{n}``, ``c\pi``
    and the latter two over a number.

    Anything else is NULL: undecided, never guessed.
    """
    return let(F.replace(text, F.lit(" "), F.lit("")), closed_value)


def closed_value(s: Column) -> Column:
    """As :func:`closed_form` for a plain column that holds no spaces; stays inside generated code."""
    def group(form: str, i: int) -> Column:
        return F.regexp_extract(s, _PARTS[form], i)

    def number(t: Column) -> Column:
        return t.try_cast("double")

    def factor(t: Column) -> Column:
        return F.when(t == "", 1.0).when(t == "-", -1.0).otherwise(number(t))

    def sign(t: Column) -> Column:
        return F.when(t == "-", -1.0).otherwise(1.0)

    def over(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0.0))

    def finite(v: Column) -> Column:
        return F.when(F.abs(v) < float("inf"), v)

    pi = F.lit(3.141592653589793)
    root = F.coalesce(F.nullif(group("root", 2), F.lit("")), group("root", 3))
    return (
        F.when(s.rlike(_PARTS["number"]), number(group("number", 1)))
        .when(s.rlike(_PARTS["ratio"]), over(number(group("ratio", 1)), number(group("ratio", 2))))
        .when(s.rlike(_PARTS["latex ratio"]), sign(group("latex ratio", 1)) * over(
            number(group("latex ratio", 2)), number(group("latex ratio", 3))))
        .when(s.rlike(_PARTS["mixed"]), number(group("mixed", 1)) + over(
            number(group("mixed", 2)), number(group("mixed", 3))))
        .when(s.rlike(_PARTS["root"]), factor(group("root", 1)) * F.sqrt(number(root)))
        .when(s.rlike(_PARTS["pi"]), factor(group("pi", 1)) * pi)
        .when(s.rlike(_PARTS["root ratio"]), sign(group("root ratio", 1)) * factor(group("root ratio", 2))
              * over(F.sqrt(number(group("root ratio", 3))), number(group("root ratio", 4))))
        .when(s.rlike(_PARTS["sum"]), number(group("sum", 1)) + number(group("sum", 2)))
        .when(s.rlike(_PARTS["product"]), number(group("product", 1)) * number(group("product", 2)))
        .when(s.rlike(_PARTS["power"]), finite(F.pow(number(group("power", 1)), number(group("power", 2)))))
        .when(s.rlike(_PARTS["scaled power"]), finite(number(group("scaled power", 1))
              * F.pow(number(group("scaled power", 2)), number(group("scaled power", 3)))))
        .when(s.rlike(_PARTS["pi ratio"]), sign(group("pi ratio", 1)) * factor(group("pi ratio", 2))
              * over(pi, number(group("pi ratio", 3))))
    )


def probe_equal(pred: Column, gold: Column, tolerance: float = 1e-9) -> Column:
    """True or false when both sides have a closed form or are the same text, NULL (undecided) otherwise."""
    decided = is_close(closed_form(pred), closed_form(gold), tolerance, tolerance)
    return F.when(pred == gold, True).otherwise(decided)


# ------------------------------------------------------------------ scalar rules of the grading profile

def is_fraction(s: Column) -> Column:
    return s.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def is_integer(s: Column) -> Column:
    value = to_number(F.regexp_replace(s, GROUP_COMMA, ""))
    return F.coalesce(F.abs(value - F.rint(value)) <= 1e-7, F.lit(False))


def mixed_to_sum(s: Column) -> Column:
    """``7 3/4`` becomes ``7+3/4``."""
    return F.regexp_replace(s, "([0-9]) +([0-9])", "$1+$2")


def element_equal(gold: Column, pred: Column) -> Column:
    """Fractions must be identical, an integer never equals a non-integer, the rest compares by value."""
    return (
        F.when(gold == pred, True)
        .when(is_fraction(gold) & is_fraction(pred), False)
        .when(is_integer(gold) != is_integer(pred), False)
        .otherwise(F.coalesce(probe_equal(pred, gold), F.lit(False)))
    )


def tuple_items(s: Column) -> Column:
    """Elements of one bracketed tuple; group commas are not separators. Other texts are one element."""
    plain = F.regexp_replace(s, GROUP_COMMA, "")
    inner = F.transform(F.split(F.regexp_extract(plain, r"(?s)^.(.*).$", 1), ",", -1), strip)
    return (
        F.when(plain == "", F.array().cast("array<string>"))
        .when(plain.rlike(r"(?s)^[()\[\]][^()\[\]]+[()\[\]]$"), inner)
        .otherwise(F.array(plain))
    )


def all_pairs_equal(a: Column, b: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """Position by position: same length and every pair equal."""
    return F.when(
        F.size(a) == F.size(b),
        F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(equal(x, y), F.lit(False))), lambda ok: ok),
    ).otherwise(False)


def grade_equal(gold_mathd: Column, pred_mathd: Column, gold: Column, pred: Column) -> Column:
    """The two-stage comparison: equal in the mathd form, else element by element in the grade form."""
    def compare(gi: Column, pi: Column) -> Column:
        brackets = (F.left(gold, F.lit(1)) == F.left(pred, F.lit(1))) & (F.right(gold, F.lit(1)) == F.right(pred, F.lit(1)))
        return F.when((F.size(gi) > 1) & ~brackets, False).otherwise(all_pairs_equal(gi, pi, element_equal))

    elements = let(tuple_items(gold), lambda gi: let(tuple_items(pred), lambda pi: compare(gi, pi)))
    return (
        F.when(gold_mathd == pred_mathd, True)
        .when(gold == pred, True)
        .when(pred == "", False)
        .otherwise(elements)
    )


# ------------------------------------------------------------------ collections

def split_depth0(s: Column) -> Column:
    """Split at commas outside round and square brackets; parts are trimmed, an empty tail is dropped."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts")
    )

    def step(acc: Column, token: Column) -> Column:
        change = F.when(token.rlike(r"[(\[]$"), 1).when(token.rlike(r"[)\]]$"), -1).otherwise(0)
        cut = token.endswith(",") & (acc["depth"] == 0)
        grown = F.concat(acc["part"], token)
        return F.struct(
            (acc["depth"] + change).alias("depth"),
            F.when(cut, "").otherwise(grown).alias("part"),
            F.when(cut, F.concat(acc["parts"], F.array(strip(F.left(grown, F.length(grown) - 1)))))
            .otherwise(acc["parts"]).alias("parts"),
        )

    return F.aggregate(
        F.split(s, r"(?<=[()\[\],])", -1), start, step,
        lambda acc: F.when(acc["part"] == "", acc["parts"]).otherwise(
            F.concat(acc["parts"], F.array(strip(acc["part"])))),
    )


def expand_pm(items: Column) -> Column:
    r"""Every item with ``\pm`` becomes two."""
    pm = r"\pm"
    return F.flatten(F.transform(items, lambda x: F.when(
        has(x, pm),
        F.array(F.replace(x, F.lit(pm), F.lit("+")), F.replace(x, F.lit(pm), F.lit("-"))),
    ).otherwise(F.array(x))))


def canonical_element(s: Column) -> Column:
    """Value text of a closed form, else the text itself: equality on it is an equivalence relation."""
    return let(closed_form(s), lambda v: F.when(v.isNotNull(), F.format_string("%.9f", v)).otherwise(s))


def one_to_one_equal(a: Column, b: Column) -> Column:
    """Same multiset of canonical elements."""
    return F.array_sort(F.transform(a, canonical_element)) == F.array_sort(F.transform(b, canonical_element))


def cover_equal(a: Column, b: Column) -> Column:
    """Every element of either side occurs on the other; repeats do not matter."""
    ca, cb = F.transform(a, canonical_element), F.transform(b, canonical_element)
    return (F.size(F.array_except(ca, cb)) == 0) & (F.size(F.array_except(cb, ca)) == 0)


def ordered_distinct(items: Column, keep_last: Column | None = None) -> Column:
    """First occurrences in order; optionally only the last ``keep_last`` of them."""
    distinct = F.array_distinct(items)
    if keep_last is None:
        return distinct
    n = F.greatest(F.least(keep_last, F.size(distinct)), F.lit(0))
    return let(distinct, lambda d: F.slice(d, F.size(d) - n + 1, n))


# ------------------------------------------------------------------ intervals, matrices, equations

def _end_equal(a: Column, b: Column) -> Column:
    plain_a, plain_b = strip(a), strip(b)
    return F.when(plain_a == plain_b, True).otherwise(F.coalesce(
        is_close(closed_form(plain_a), closed_form(plain_b), 0.0, TOLERANCES["olympiad"].abs), F.lit(False)))


def interval_brackets(s: Column) -> Column:
    """``Interval(a,b)``, its open forms and ``Point(a,b)`` in bracket notation; other texts stay."""
    for name, left, right in (("Point", "(", ")"), ("Interval", "[", "]"), (r"Interval\.Ropen", "[", ")"), (r"Interval\.Lopen", "(", "]"), (r"Interval\.open", "(", ")")):
        s = F.regexp_replace(s, rf"(?s)^{name}\((.*)\)$", f"{left}$1{right}")
    return s


def interval_equal(a: Column, b: Column) -> Column:
    r"""Unions part by part: the same brackets and equal ends."""
    def part_equal(x: Column, y: Column) -> Column:
        def inner(v: Column) -> Column:
            return F.split(F.regexp_replace(v, r"^[\[\]()]+|[\[\]()]+$", ""), ",", -1)

        same = (F.left(x, F.lit(1)) == F.left(y, F.lit(1))) & (F.right(x, F.lit(1)) == F.right(y, F.lit(1)))
        return same & all_pairs_equal(inner(x), inner(y), _end_equal)

    def parts(v: Column) -> Column:
        return F.transform(F.split(v, r"\\cup", -1), strip)

    return F.when(a == b, True).otherwise(all_pairs_equal(parts(a), parts(b), part_equal))


def set_as_matrix(s: Column) -> Column:
    """``{a,b}`` as a matrix of one column; other texts stay."""
    body = F.regexp_extract(s, r"(?s)^\s*\{(.*,.*)\}\s*$", 1)
    return F.when(body != "", F.concat(
        F.lit(r"\begin{pmatrix}"), F.replace(body, F.lit(","), F.lit("\\\\")), F.lit(r"\end{pmatrix}"))).otherwise(s)


def matrix_cells(s: Column) -> Column:
    r"""Rows (``\\``) of cells (``&``) of a pmatrix or bmatrix; NULL for other texts."""
    body = F.regexp_extract(s, r"(?s)^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$", 1)
    rows = F.filter(F.transform(F.split(body, r"\\\\", -1), strip), lambda r: r != "")
    cells = F.transform(rows, lambda r: F.transform(F.split(r, "&", -1), strip))
    return F.when(s.rlike(r"(?s)^\\begin\{[pb]matrix\}.*\\end\{[pb]matrix\}$"), cells)


def cell_equal(a: Column, b: Column) -> Column:
    return F.when(a == b, True).otherwise(F.coalesce(
        numeric_equal(closed_form(a), closed_form(b), "minerva"), F.lit(False)))


def matrix_equal(a: Column, b: Column) -> Column:
    """Same shape and every cell equal; NULL when either side is no matrix."""
    return let(matrix_cells(a), lambda ma: let(matrix_cells(b), lambda mb: F.when(
        ma.isNotNull() & mb.isNotNull(),
        all_pairs_equal(ma, mb, lambda ra, rb: all_pairs_equal(ra, rb, cell_equal)),
    )))


def equation_value(s: Column) -> Column:
    """Right side of ``x = v`` when there is one sign and at most two characters on its left."""
    return let(F.split(s, "=", -1), lambda p: F.when(
        (F.size(p) == 2) & (F.length(strip(p[0])) <= 2), strip(F.element_at(p, 2))).otherwise(strip(s)))


def linear_equation(s: Column) -> Column:
    """``ax+b=c`` with numbers a, b, c as the array [a, b-c]; NULL for other texts."""
    pattern = r"^(-?\d*\.?\d*)\*?[a-z]([+-]\d+(?:\.\d+)?)?=(-?\d+(?:\.\d+)?)$"
    def read(t: Column) -> Column:
        a = F.regexp_extract(t, pattern, 1)
        slope = F.when(a == "", 1.0).when(a == "-", -1.0).otherwise(a.try_cast("double"))
        shift = F.coalesce(F.regexp_extract(t, pattern, 2).try_cast("double"), F.lit(0.0))
        return F.when(t.rlike(pattern), F.array(slope, shift - F.regexp_extract(t, pattern, 3).try_cast("double")))
    return let(F.replace(s, F.lit(" "), F.lit("")), read)


def equation_equal(a: Column, b: Column) -> Column:
    """Two linear equations are equal when one difference of sides equals the other up to sign."""
    def same(x: Column, y: Column, sign: int) -> Column:
        return F.forall(F.zip_with(x, y, lambda p, q: F.abs(p - sign * q) <= 1e-9), lambda ok: ok)

    return let(linear_equation(a), lambda x: let(linear_equation(b), lambda y: F.when(
        x.isNotNull() & y.isNotNull(), same(x, y, 1) | same(x, y, -1))))


# ------------------------------------------------------------------ dates and screens

def normalize_datetime(s: Column) -> Column:
    """Canonical date, time or date and time of a text in one of the known formats, else NULL."""
    parsed = F.coalesce(*[F.try_to_timestamp(_padded(s), F.lit(fmt)) for fmt in rules.DATETIME_FORMATS])
    has_time, has_date = has(s, ":"), has(s, "/") | has(s, "-")
    return (
        F.when(has_date & has_time, F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"))
        .when(has_date, F.date_format(parsed, "yyyy-MM-dd"))
        .when(has_time, F.date_format(parsed, "HH:mm:ss"))
    )


def _padded(s: Column) -> Column:
    """Single-digit fields get their leading zero, as the lenient formats allow."""
    return F.regexp_replace(s, r"(?<![0-9])([0-9])(?![0-9])", "0$1")


def unknown_letters(s: Column) -> Column:
    """Number of distinct letters left after the known function and constant names are removed."""
    rest = s
    for word in rules.KNOWN_WORDS:
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return F.size(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"(\p{L})"), 1)))


def may_evaluate(s: Column) -> Column:
    """Whether an expression is small and safe enough to evaluate."""
    unsafe = s.rlike("|".join(rules.UNSAFE_PATTERNS))
    for text in rules.UNSAFE_TEXTS:
        unsafe = unsafe | has(s, text)
    return (unknown_letters(s) <= 2) & ~unsafe
