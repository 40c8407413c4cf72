"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import documents
from veritrace.llm.registry import query
from veritrace.session import materialize

#: At most about this many labelled rows are used to find voters and to fit the classifier, chosen by a hash of the id.
FIT_ROWS = 30_000
#: Words and beginnings of words that the classifier weighs; the most telling ones are taken, and the first of them vote.
MARKS, VOTERS = 1000, 160
#: Letters of the beginnings of words that may vote.
BEGINNINGS = (4, 5, 6)
#: A mark needs so many toxic texts, and such a share of toxic ones among those that have it.
LEAST_TEXTS, LEAST_PRECISION = 5, 0.5
#: Accuracy with which a human label enters the posterior of its text.
LABEL_ACCURACY = 0.95
ROUNDS = 4


def signals(text: Column) -> Column:
    """The distinct words of a text in lower case and their beginnings, written as ``beginning-``."""
    found = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    parts = [F.transform(F.filter(found, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in BEGINNINGS]
    return F.array_remove(F.array_distinct(F.concat(found, *parts)), "")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def find_marks(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The signals that mark toxic texts best, at most ``MARKS``, best first."""
    counts = sample.select("_toxic", F.explode("_signals").alias("signal")).groupBy("signal").agg(
        F.sum("_toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    precision = (F.col("toxic") + 0.5) / (F.col("n") + 1)
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    best = counts.where((F.col("toxic") >= LEAST_TEXTS) & (precision >= LEAST_PRECISION)).withColumn(
        "worth", F.col("toxic") * F.log(precision / base))
    return [r[0] for r in best.orderBy(F.desc("worth"), "signal").limit(MARKS).select("signal").collect()]


def posterior_odds(votes: Column, label: Column, weights: dict[str, float], intercept: float) -> Column:
    """Log odds of toxic given the voters that marked a text, and its label where there is one."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    total = F.aggregate(votes, F.lit(float(intercept)), lambda acc, v: acc + F.coalesce(F.element_at(table, v), F.lit(0.0)))
    trust = math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    return total + F.when(label == 1, trust).when(label == 0, -trust).otherwise(0.0)


def label_model(votes: DataFrame, voters: list[str], prior: float) -> tuple[dict[str, float], float]:
    """Weights of the voters and the intercept, from ``_votes`` and ``_toxic`` of all texts, labelled or not.

    The model says that a voter marks a toxic text with one probability and a clean text with another. Both are
    estimated from the votes on the whole corpus by expectation and maximisation. Voters that mark the same toxic texts
    are correlated beyond the class: from the expected joint counts each voter gets the sum of its squared correlations
    with all voters, itself included, and its weight is divided by it, so that a word and its beginning count about
    once. What comes to the driver are sums per voter and per pair of voters, at most ``VOTERS ** 2`` numbers.
    """
    sets = materialize(votes.groupBy("_votes", "_toxic").count(), "vote-sets")
    at = {v: i for i, v in enumerate(voters)}
    marks_toxic, marks_clean, shared = np.full(len(voters), 0.2), np.full(len(voters), 0.2 * prior / 4), np.ones(len(voters))
    weights, intercept = {}, math.log(prior / (1 - prior))
    for step in range(ROUNDS):
        ratio = np.log(marks_toxic / marks_clean) / shared
        weights, intercept = dict(zip(voters, ratio.tolist(), strict=True)), math.log(prior / (1 - prior))
        chance = 1 / (1 + F.exp(-posterior_odds(F.col("_votes"), F.col("_toxic"), weights, intercept)))
        scored = sets.withColumn("p", chance)
        all_texts = scored.agg(F.sum(F.col("count") * F.col("p")), F.sum("count")).first()
        toxic, total = float(all_texts[0] or 0), float(all_texts[1] or 0)
        if not voters or not toxic:
            break
        if step < ROUNDS - 1:
            rows = scored.select(F.explode("_votes").alias("v"), (F.col("count") * F.col("p")).alias("t"), "count").groupBy("v").agg(
                F.sum("t").alias("t"), F.sum("count").alias("n")).collect()
            for v, t, n in rows:
                marks_toxic[at[v]] = (t + 0.5) / (toxic + 1)
                marks_clean[at[v]] = (n - t + 0.5) / (total - toxic + 1)
            marks_toxic = np.maximum(marks_toxic, marks_clean * 1.01)
        if step == ROUNDS - 2:
            pairs = scored.select("_votes", (F.col("count") * F.col("p")).alias("t"), F.explode("_votes").alias("a"))
            pairs = pairs.select("a", F.explode("_votes").alias("b"), "t").where("a <= b").groupBy("a", "b").agg(F.sum("t").alias("t")).collect()
            joint = np.zeros((len(voters), len(voters)))
            for a, b, t in pairs:
                joint[at[a], at[b]] = joint[at[b], at[a]] = t / toxic
            spread = np.sqrt(marks_toxic * (1 - marks_toxic)) + 1e-9
            correlation = np.clip((joint - np.outer(marks_toxic, marks_toxic)) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(correlation, 1)
            shared = (correlation ** 2).sum(axis=1)
    return weights, intercept


def scored(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """``_row`` (id and the columns in ``carry``) with ``score``, the chance from 0 to 1 that the text is toxic.

    ``labels`` has ``doc_id`` and ``toxic``; held-out rows are not read, an id labelled twice is toxic if any label says
    so. Marks and the classifier are learnt from at most about ``FIT_ROWS`` labelled texts, the label model from the
    votes on all texts. A score depends on the words of the text alone. Null and empty texts get the score of a text
    without marks; without toxic and clean labels, or without a mark, every score is 0. Null ids and repeated rows keep
    their own scores; an empty table gives no rows.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("toxic").cast("int").alias("_toxic"))
    known = materialize(known, "labels")
    share = min(1.0, FIT_ROWS / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))  # about FIT_ROWS rows of 12 bytes
    row = F.struct(F.col(id_col).alias("_id"), *[F.col(c) for c in carry]).alias("_row")
    texts = docs.select(row, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = texts.select("_id", "_text").join(F.broadcast(chosen), "_id").select(signals(F.col("_text")).alias("_signals"), "_toxic")
    sample = materialize(labelled, "labelled-signals")
    sizes = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    marks = find_marks(sample, sizes[1], sizes[0]) if sizes.get(1) and sizes.get(0) else []
    if not marks:
        return texts.select("_row", F.lit(0.0).alias("score"))
    among = lambda c, names: F.array_sort(F.array_intersect(c, F.array(*[F.lit(v) for v in names])))
    found_marks = among(signals(F.col("_text")), marks).alias("_marks")
    marked = materialize(texts.select(F.struct("_id").alias("_row"), "_id", found_marks), "marked-texts")
    voters, prior = marks[:VOTERS], sizes[1] / (sizes[0] + sizes[1])
    votes = marked.select("_id", "_marks").join(F.broadcast(chosen), "_id", "left").select(
        "_marks", among(F.col("_marks"), voters).alias("_votes"), "_toxic")
    weights, intercept = label_model(votes, voters, prior)
    chance = 1 / (1 + F.exp(-posterior_odds(F.col("_votes"), F.col("_toxic"), weights, intercept)))
    soft = votes.where("_toxic is not null").withColumn("_p", chance)
    both = soft.select("_marks", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("_p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("_p")).alias("weight")))).alias("x")).select("_marks", "x.*").where("weight > 0.001")
    vectors = CountVectorizerModel.from_vocabulary(marks, inputCol="_marks", outputCol="features", minTF=0.0).setBinary(True)
    rows = materialize(vectors.transform(both).select("label", "weight", "features"), "posterior-labels")
    model = LogisticRegression(maxIter=30, regParam=1e-4, weightCol="weight", standardization=False).fit(rows)
    model.setRawPredictionCol("").setPredictionCol("")
    if carry:  # whole rows are read again rather than written
        marked = texts.select("_row", found_marks)
    found = model.transform(vectors.transform(marked.select("_row", "_marks")))
    return found.select("_row", vector_to_array("probability")[1].alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score below one half."""
    whole = docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return scored(whole, labels, carry=("_whole",), **options).where("score < 0.5").select("_row._whole.*")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        F.col("_row._id").alias("doc_id"), held_out(F.col("_row._id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
