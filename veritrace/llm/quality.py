"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import documents, salted_join, spread_keys, words
from veritrace.llm.registry import query
from veritrace.session import materialize

#: Words of a window; a window found twice repeats.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rule name to the share it measures; a text is rejected when the share is over the cutoff.
RULES = ("symbol_share", "upper_share", "repeat_share", "dup_line_share")
#: Cutoffs that may be chosen, fixed before any label is seen.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
#: Chosen cutoffs of more strata than this are joined by a shuffle instead of a broadcast (under 100 bytes each).
BROADCAST_STRATA = 10_000


def features(docs: DataFrame, text_col: str = "text", carry: str = "_row") -> DataFrame:
    """``carry`` (a column of ``docs``) with word counts and shares of the whole text; a null text has none of either.

    ``n_repeat_words`` are the words in windows of eight words that the text holds twice or more. Windows are told
    apart by 64-bit hashes; only texts with an equal pair are looked at closer.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        carry, words(F.col(text_col)).alias("_w"), lines.alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"))
    window = F.when(F.size("_w") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    b = a.select(
        carry, "n_symbols", "n_upper", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), window.alias("_h"))
    ordered = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    c = b.withColumn("_s", ordered)
    twice = F.filter(F.transform("_s", lambda x, i: F.when(
        F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False)),
        x["p"])), lambda p: p.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")))["n"]
    d = c.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    return d.select(
        carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed term by term in logarithms; 1 where k is over the mean."""
    odds = F.lit(p / (1 - p))
    start = n * F.log(F.lit(1 - p))
    summed = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(start.alias("term"), start.alias("total")),
        lambda acc, i: (lambda term: F.struct(
            term.alias("term"),
            (F.greatest(term, acc["total"]) + F.log1p(F.exp(-F.abs(term - acc["total"])))).alias("total")))(
                acc["term"] + F.log((n - i + 1) / i * odds)))["total"]
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(F.exp(summed))


def select_cutoffs(holdout: DataFrame, stratum: str, max_false_reject: float, error: float) -> DataFrame:
    """Per stratum the smallest safe cutoff of each rule, null where none is.

    ``holdout`` has a row for each labelled good text that passes the base rules. A cutoff is safe when the hypothesis
    that more than ``max_false_reject / rules`` of the good texts of its stratum lie over it is rejected by the exact
    binomial test. Cutoffs of a rule are tested from lax to strict up to the first that fails, which needs no
    correction; over rules and strata the error is divided (Bonferroni). So with probability ``1 - error`` no stratum
    loses more than ``max_false_reject`` of its good texts to all rules together.
    """
    counts = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col(rule) > c, 1)).alias(f"{rule}_{i}") for rule in RULES for i, c in enumerate(CUTOFFS)])
    strata = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))), F.lit(1))
    tests = counts.withColumn("_strata", strata).select(stratum, "n", "_strata", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
        for rule in RULES for i, c in enumerate(CUTOFFS)])).alias("t")).select(stratum, "n", "_strata", "t.*")
    tail = binomial_tail(F.col("k"), F.col("n"), max_false_reject / len(RULES))
    tests = tests.withColumn("safe", (tail <= F.lit(error) / (F.col("_strata") * len(RULES))).cast("int"))
    so_far = Window.partitionBy(stratum, "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    safe = tests.withColumn("safe", F.min("safe").over(so_far)).where("safe = 1")
    return safe.groupBy(stratum).agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    carry: tuple[str, ...] = (), max_false_reject: float = 0.02, error: float = 0.05,
) -> DataFrame:
    """``_row`` (id, stratum and the columns in ``carry``) with counts, shares, ``base_failed`` and ``kept``.

    A text is kept unless a base rule or a cutoff of its stratum rejects it. Strata whose labels prove no cutoff, and
    texts without a stratum, are judged by the base rules alone. ``labels`` has ``doc_id`` and ``quality``; an id that
    is labelled twice counts as good if any label says so. Null texts have no words and fail the base rules; null ids
    have no label; repeated rows keep their own verdicts; empty tables give no rows.
    """
    row = F.struct(F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum"), *[F.col(c) for c in carry])
    measured = materialize(features(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), "_text"), "quality-features")
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q")).where("_q = 1").select("_id")
    holdout = measured.where("not base_failed").select(F.col("_row._id").alias("_id"), F.col("_row._stratum").alias("_stratum"), *RULES)
    cutoffs = materialize(
        select_cutoffs(holdout.join(good, "_id", "left_semi"), "_stratum", max_false_reject, error).where("_stratum is not null"), "cutoffs")
    keyed = measured.withColumn("_stratum", F.col("_row._stratum"))
    if cutoffs.count() <= BROADCAST_STRATA:
        judged = keyed.join(F.broadcast(cutoffs), "_stratum", "left")
    else:
        sizes = materialize(keyed.groupBy("_stratum").count(), "strata")
        hot = spread_keys(sizes, "_stratum", "count", sizes.agg(F.sum("count")).first()[0])
        judged = salted_join(keyed.withColumn("_deal", F.col("_row._id")), cutoffs, "_stratum", "_deal", hot).drop("_deal")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_verdicts`` keeps."""
    kept = quality_verdicts(docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), labels, carry=("_whole",), **options)
    return kept.where("kept").select("_row._whole.*")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select(
        F.col("_row._id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", *RULES)
