"""Column expressions that take a response text apart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrace.functions import rules

#: Whitespace that trimming removes. Spark's bare ``trim`` removes only spaces.
BLANKS = " \t\r\n"
NUMBER = r"-?\d*\.?\d+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that ``body`` can use it many times without repeating its evaluation."""
    return F.transform(F.array(value), body).getItem(0)


def quote(literal: str) -> str:
    """A literal as a regular expression that reads the same in Python and Java."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def lstrip(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def has(text: Column, literal: str) -> Column:
    return text.contains(literal)


def after_first(text: Column, mark: str) -> Column:
    return F.regexp_extract(text, f"(?s){quote(mark)}(.*)", 1)


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def drop(text: Column, *literals: str) -> Column:
    for literal in literals:
        text = F.replace(text, F.lit(literal), F.lit(""))
    return text


def closing_length(tail: Column) -> Column:
    """Characters up to and including the brace that closes an already opened one; 0 when none does.

    The text is folded brace by brace rather than character by character, and only where it has both kinds.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token.endswith("{"), 1).when(token.endswith("}"), -1).otherwise(0)
        grown = F.struct(depth.alias("depth"), (acc["used"] + F.length(token)).alias("used"))
        return F.when(acc["depth"] == 0, acc).otherwise(grown)

    folded = F.aggregate(
        F.split(tail, r"(?<=[{}])"), start, step, lambda acc: F.when(acc["depth"] == 0, acc["used"]).otherwise(0)
    )
    return F.when(~has(tail, "{") | ~has(tail, "}"), F.instr(tail, "}")).otherwise(folded)


def balanced(tail: Column) -> Column:
    """Text up to the brace that closes an already opened one; NULL when it never closes."""
    return let(tail, lambda t: let(closing_length(t), lambda n: F.when(n > 0, F.substring(t, F.lit(1), n - 1))))


def last_boxed(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}``; NULL without one or when it is not balanced."""
    tail = after_last(text, r"\boxed")
    return F.when(has(text, r"\boxed"), let(tail, lambda t: F.when(t.startswith("{"), balanced(F.substring(t, F.lit(2), F.length(t))))))


def all_boxed(text: Column, opener: str = "boxed{", whole_text: bool = True, keep_percent: bool = False) -> Column:
    """Contents of every balanced box, in order.

    A box normally closes before the next one opens. Only when it does not, and ``whole_text`` allows boxes
    inside boxes, is the rest of the text searched.
    """
    def contents(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            rest = F.array_join(F.slice(pieces, i + 2, F.size(pieces)), opener)
            own = balanced(piece)
            if keep_percent:
                own = let(
                    F.coalesce(closing_length(piece), F.lit(0)),
                    lambda n: F.when(
                        n > 0,
                        F.when(F.substring(piece, n + 1, F.lit(1)) == "%", F.substring(piece, F.lit(1), n))
                        .otherwise(F.substring(piece, F.lit(1), n - 1)),
                    ),
                )
            return F.coalesce(own, balanced(rest)) if whole_text else own

        return F.filter(F.transform(F.slice(pieces, 2, F.size(pieces)), one), lambda c: c.isNotNull())

    return let(F.split(text, quote(opener), -1), contents)


def box_count(text: Column) -> Column:
    return F.size(F.split(text, r"\\boxed", -1)) - 1


def last_number(text: Column) -> Column:
    """Last number of a text after its commas are dropped; empty when there is none."""
    return F.coalesce(last(F.regexp_extract_all(drop(text, ","), F.lit(NUMBER), 0)), F.lit(""))


def thinking(text: Column) -> Column:
    """Text between the first ``<think>`` and the first ``</think>``; the whole text when it never closes."""
    head = before_first(text, "</think>")
    inner = F.regexp_replace(head, r"(?s)^.*?<think>", "")
    return F.when(has(text, "</think>"), strip(inner)).otherwise(strip(text))


def answer_part(text: Column, missing: str = "") -> Column:
    """Text after the first ``</think>``; ``missing`` when there is none."""
    return F.when(has(text, "</think>"), strip(after_first(text, "</think>"))).otherwise(F.lit(missing))


def pack_index(answer: Column, key: Column) -> Column:
    return F.concat(answer, F.lit(" <index>"), key.cast("string"), F.lit("</index>"))


def unpack_index(packed: Column) -> tuple[Column, Column]:
    """The answer without its index tags, and the first index (NULL when absent)."""
    found = F.regexp_extract(packed, r"<index>(.*?)</index>", 1)
    index = F.when(packed.rlike(r"<index>.*?</index>"), found)
    return strip(F.regexp_replace(packed, r"<index>.*?</index>", "")), index


def by_pattern(text: Column, pattern: str) -> Column:
    """First group of the first match, NULL without a match. A dot stops at a newline only."""
    return F.when(text.rlike(f"(?d){pattern}"), F.regexp_extract(text, f"(?d){pattern}", 1))


def clean_edges(text: Column) -> Column:
    """Drop the punctuation that may neither start nor end an answer."""
    return clean_end(F.regexp_replace(strip(text), r"""(?U)^[\s!)\]}:/,#?$"'ки]+""", ""))


def clean_end(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?U)[\s(\[{\\.:/,#?$"'ки]+$""", "")


def cascade_raw(text: Column) -> Column:
    """Extraction in falling order of trust: final-answer phrase, last box, answer phrase, last number."""
    phrase = strip(before_first(after_first(text, "final answer is $"), "$. I hope"))
    boxed = F.coalesce(last(all_boxed(text, whole_text=False, keep_percent=True)), F.lit(""))
    return (
        F.when(has(text, "final answer is $") & has(text, "$. I hope"), phrase)
        .when(has(text, "boxed"), boxed)
        .when(has(text, "he answer is"), strip(after_last(text, "he answer is")))
        .otherwise(last_number(text))
    )


def tidy_extracted(text: Column) -> Column:
    """First line of an extracted answer without a leading colon or trailing stops and slashes."""
    return rstrip(rstrip(lstrip(before_first(strip(text), "\n"), ":"), "."), "/")


def loose_box(text: Column) -> Column:
    """Last box in the evaluator's reading: escaped braces do not count, an unclosed box runs to the end and a
    braceless one to the next ``$``."""
    def masked(s: Column) -> Column:
        return F.replace(F.replace(s, F.lit(r"\{"), F.lit("\x01")), F.lit(r"\}"), F.lit("\x02"))

    def unmasked(s: Column) -> Column:
        return F.replace(F.replace(s, F.lit("\x01"), F.lit(r"\{")), F.lit("\x02"), F.lit(r"\}"))

    def read(tail: Column) -> Column:
        inner = masked(F.substring(tail, F.lit(2), F.length(tail)))
        return (
            F.when(tail.startswith("{"), unmasked(let(inner, lambda i: F.coalesce(balanced(i), i))))
            .otherwise(strip(before_first(tail, "$")))
        )

    return let(after_last(text, "oxed"), read)


def truth_word(text: Column) -> Column:
    """``True``/``False`` when the text contains yes/true or no/false, else NULL."""
    low = F.replace(F.lower(strip(text)), F.lit("noindent"), F.lit(""))
    return let(low, lambda s: F.when(has(s, "yes") | has(s, "true"), "True").when(has(s, "no") | has(s, "false"), "False"))


def explicit_answer(text: Column) -> Column:
    """Answer announced by a marker; NULL when no marker is present."""
    def before_is(resp: Column, mark: str) -> Column:
        head = strip(F.element_at(F.split(resp, quote(mark), -1), -2))
        return strip(F.regexp_replace(head, r"(?s)^.*(?:,|\.|!\|?)", ""))

    def undollar(resp: Column) -> Column:
        return let(resp, lambda r: F.when(r.rlike(r"(?s)^\$.*\$$"), F.regexp_replace(r, r"(?s)^\$(.*)\$$", "$1")).otherwise(r))

    def marked(resp: Column) -> Column:
        verdict = truth_word(strip(after_last(resp, "is ")))
        return (
            F.when(has(resp, "oxed{"), loose_box(resp))
            .when(has(resp, "is the ans"), undollar(before_is(resp, "is the ans")))
            .when(has(resp, "is our ans"), undollar(before_is(resp, "is our ans")))
            .when(has(resp, "answer is"), undollar(strip(after_last(resp, "answer is"))))
            .when(has(resp, "answer:"), undollar(strip(after_last(resp, "answer:"))))
            .when(has(resp, "answer :"), undollar(strip(after_last(resp, "answer :"))))
            .when(has(resp, "statement"), F.coalesce(verdict, undollar(resp)))
        )

    def after_marks(s: Column) -> Column:
        tagged = has(s, "<|start_answer|>") & has(s, "<|end_answer|>")
        inside = strip(before_first(F.element_at(F.split(s, quote("<|start_answer|>"), -1), 2), "<|end_answer|>"))
        hashed = F.when(has(s, "####"), strip(after_last(s, "####"))).otherwise(s)
        named = let(hashed, lambda h: F.when(has(h, "# Answer"), strip(after_last(h, "# Answer"))).otherwise(h))
        return F.when(tagged, inside).otherwise(let(named, marked))

    return let(clean_end(strip(text)), after_marks)


def extract_by_mode(text: Column, mode: str) -> Column:
    """``boxed``, ``explicit`` or ``speculate``; the empty string when nothing is found."""
    if mode == "boxed":
        return F.when(has(text, "oxed{"), loose_box(text)).otherwise("")
    if mode == "explicit":
        return F.coalesce(explicit_answer(text), F.lit(""))
    if mode == "speculate":
        formula = last(F.regexp_extract_all(text, F.lit(r"(?:\$|\\\(|\\\[)([^\$]+)(?:\$|\\\(|\\\[)"), 1))
        return F.coalesce(formula, last_number(text))
    raise ValueError(f"unknown extraction mode {mode!r}")


def choice_letter(text: Column) -> Column:
    """Last stand-alone letter A to E, else the trimmed text."""
    trimmed = lstrip(F.trim(rstrip(rstrip(F.trim(text, F.lit("\n")), "."), "/"), F.lit(" ")), ":")

    def pick(s: Column) -> Column:
        letter = last(F.regexp_extract_all(F.upper(s), F.lit(r"(?U)\b([A-E])\b"), 1))
        return F.coalesce(letter, F.trim(strip(s), F.lit(".")))

    return rstrip(rstrip(let(trimmed, pick), "."), "/")


def local_choice(text: Column) -> Column:
    """Letter after the first localized "Answer:" marker that occurs, in marker order; NULL without one."""
    found = [by_pattern_any(text, rf"(?iu){marker}\s*({rules.ANSWER_LETTERS})") for marker in rules.ANSWER_MARKERS]
    return F.translate(F.coalesce(*found), rules.LOCAL_LETTERS, rules.LATIN_LETTERS)


def by_pattern_any(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def strip_math(text: Column) -> Column:
    """Text without its formulas, for language checks."""
    blocks = F.regexp_replace(text, r"(?s)\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]", "")
    return F.regexp_replace(blocks, r"\$[^$]*\$", "")


def spans(text: Column, opener: str, closer: str, greedy: bool = False) -> Column:
    """All non-overlapping ``opener ... closer`` matches as structs of begin and end offsets.

    The text is split at its matches; the lengths of matches and gaps give the offsets in one fold.
    """
    pattern = f"(?s){quote(opener)}.{'*' if greedy else '*?'}{quote(closer)}"
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.length(m))
    nothing = F.array().cast("array<struct<begin:int,end:int>>")
    start = F.struct(F.lit(0).alias("pos"), nothing.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["pos"] + pair["gap"]
        end = begin + pair["hit"]
        span = F.struct(begin.alias("begin"), end.alias("end"))
        return F.when(pair["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        )

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda acc: acc["out"])


def tokens(text: Column) -> Column:
    """Lower-case words; ASCII punctuation separates words."""
    plain = F.regexp_replace(F.lower(text), r"\p{Punct}", " ")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda t: t != "")


def numbers(text: Column) -> Column:
    """Every number in a text, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"), 0)
    return F.filter(F.transform(found, lambda n: n.try_cast("double")), lambda n: n.isNotNull())


def any_number_match(predicted: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """True when some predicted number is close to some gold number; row-local, over the two distinct sets."""
    def finite(values: Column) -> Column:
        return F.array_distinct(F.filter(values, lambda v: F.abs(v) < float("inf")))

    def close(p: Column, g: Column) -> Column:
        return F.abs(p - g) <= tolerance * F.greatest(F.lit(1.0), F.abs(g))

    return let(finite(gold), lambda gs: F.exists(finite(predicted), lambda p: F.exists(gs, lambda g: close(p, g))))


def training_messages(question: Column, thinking: Column, answer: Column, system: Column) -> Column:
    r"""``array(struct(role, content))``: system, user, and the assistant's ``<think>`` part with its boxed answer.

    Without an answer (NULL) the assistant's turn is left out, which is the form a model is asked in.
    """
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    reply = F.concat(F.lit("<think>\n"), strip(F.coalesce(thinking, F.lit(""))), F.lit("\n</think>\n\n\\boxed{"), strip(answer), F.lit("}"))
    asked = F.array(message("system", system), message("user", question))
    return F.when(answer.isNull(), asked).otherwise(F.concat(asked, F.array(message("assistant", reply))))
