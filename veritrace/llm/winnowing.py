"""Winnowing fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import documents, words
from veritrace.llm.registry import query

#: Words of a gram and grams of a window: a run of GRAM + WINDOW - 1 words that two texts share is always found.
GRAM = 5
WINDOW = 8
#: A pick holds 31 bits of hash above 31 bits that fall as the position grows, so the least pick of a window is its
#: least hash, rightmost among ties.
_BITS = 31
_LAST = (1 << _BITS) - 1
#: Ranges of ids that tasks work on when documents are set beside the next one, as a square of this.
RANGES = 16


def with_picks(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``, the picks of the text in order of position; none for a text without words.

    Grams are runs of ``GRAM`` words, or the whole text when it is shorter. Each window of ``WINDOW`` grams (or all grams
    when there are fewer) picks its least hash.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(*keep, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("_h"))
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - _BITS), _BITS).bitwiseOR(F.lit(_LAST).cast("long") - i)
    grams = F.when(F.size("_h") == 0, F.array().cast("array<bigint>")).when(
        F.size("_h") <= GRAM, F.array(pack(F.xxhash64("_h"), F.lit(1)))).otherwise(F.transform(
            F.sequence(F.lit(1), F.size("_h") - (GRAM - 1)), lambda i: pack(F.xxhash64(F.slice("_h", i, GRAM)), i)))
    packed = hashed.select(*keep, grams.alias("_g"))
    picks = F.when(F.size("_g") <= WINDOW, F.filter(F.array(F.array_min("_g")), lambda x: x.isNotNull())).otherwise(
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("_g") - (WINDOW - 1)), lambda i: F.array_min(F.slice("_g", i, WINDOW)))))
    return packed.select(*keep, picks.alias(name))


def pick_hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftright(p, _BITS)))


def fingerprint_text(picks: Column) -> Column:
    """The picks as ``hash@position`` (hexadecimal, word number from 1), joined by blanks."""
    return F.array_join(F.transform(picks, lambda p: F.concat(
        F.lower(F.hex(F.shiftright(p, _BITS))), F.lit("@"), (F.lit(_LAST).cast("long") - p.bitwiseAND(F.lit(_LAST).cast("long"))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Share of the hashes of two fingerprints that both have; 1 when neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def beside_next(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the following row by (key, tie); the last row is followed by the first.

    Rows are dealt by ranges of the key, cut at quantiles. The first row of each range is also sent to the range
    before it, so one shuffle is enough and no task holds all rows. A null key comes first.
    """
    n = RANGES * RANGES
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    cuts = sorted(set(found or []))
    coarse = cuts[RANGES - 1::RANGES]
    fine = [cuts[i:i + RANGES - 1] for i in range(0, len(cuts) or 1, RANGES)] or [[]]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(key)))
    group = below(array(coarse))
    span = (group * RANGES + F.coalesce(below(F.get(F.array(*[array(f) for f in fine]), group)), F.lit(0))).cast("int")
    ranged = df.withColumn("_span", F.coalesce(span, F.lit(0)))
    firsts = {r[0]: r[1] for r in ranged.groupBy("_span").agg(F.min(F.struct(key, tie)).alias("first")).collect()}  # RANGES ** 2 rows
    spans = sorted(firsts)
    by_span = [firsts.get(i) for i in range((max(spans) if spans else 0) + 1)]
    prior = {s: spans[i - 1] for i, s in enumerate(spans)}
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_span"))
    is_first = F.col(key).eqNullSafe(at([f and f[0] for f in by_span], "long")) & (F.col(tie) == at([f and f[1] for f in by_span], "long"))
    here = F.struct(F.col("_span").alias("span"), F.lit(0).alias("guard"))
    there = F.struct(at([prior.get(i) for i in range(len(by_span))], "int").alias("span"), F.lit(1).alias("guard"))
    sent = ranged.withColumn("_to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("_to.span").orderBy("_to.guard", key, tie)
    following = sent.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where("_to.guard = 0")
    return following.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how much they are alike.

    The edited text is the text with its last floor(n / 2) characters replaced by the first as many of the next document
    by id. Per row: id, n_chars, edited (text), picks, edited_picks, and the likeness to the edited text and to the next
    document. A null text is an empty one; empty texts have no picks. Rows with equal ids follow each other by the hash
    of their texts, a null id comes first; a single row is its own next; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_tie"))
    rows = beside_next(rows, "_id", "_tie", ["_text"])
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half), F.substring(F.col("next__text"), F.lit(1), half))
    rows = rows.select("_id", "_text", "next__text", F.length("_text").cast("long").alias("n_chars"), edited.alias("edited"))
    for text_of, picks in (("_text", "picks"), ("edited", "edited_picks"), ("next__text", "next_picks")):
        rows = with_picks(rows, text_of, picks)
    rows = rows.select(
        "_id", "n_chars", "edited", "picks", "edited_picks",
        *[pick_hashes(F.col(p)).alias(f"_{p}") for p in ("picks", "edited_picks", "next_picks")])
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", "edited", "picks", "edited_picks",
        likeness("_picks", "_edited_picks").alias("near_edited"), likeness("_picks", "_next_picks").alias("near_next"))


@query("op5_winnowing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("picks")).alias("fingerprint"), fingerprint_text(F.col("edited_picks")).alias("edited_fingerprint"),
        "near_edited", "near_next")
