"""Language consistency by character trigrams learned from the labelled texts themselves."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.session import materialize, spread

# Executors need not have this package installed: its few Python functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A text this short is taken as consistent.
SHORT_TEXT = 15
#: Trigrams beyond this many are joined by shuffle instead of broadcast (about 100 bytes each).
MAX_BROADCAST_GRAMS = 500_000
#: Trigrams a task holds in numpy before it hands on their counts.
CHUNK = 1 << 20


def trigrams(text: str | None) -> np.ndarray:
    """Overlapping triples of code points, each triple one number of 63 bits."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) > 2 else points[:0]


def _by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and text come; key, trigram and how often the text holds it go."""
    for batch in batches:
        rows, grams, ns, size = [], [], [], 0

        def flat() -> pa.RecordBatch:
            keys = batch.column(0).take(pa.array(np.repeat(rows, [len(g) for g in grams])))
            return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(grams)), pa.array(np.concatenate(ns))], ["key", "gram", "n"])

        for row, text in enumerate(batch.column(1)):
            found, n = np.unique(trigrams(text.as_py()), return_counts=True)
            rows.append(row), grams.append(found), ns.append(n)
            size += len(found)
            if size >= CHUNK:
                yield flat()
                rows, grams, ns, size = [], [], [], 0
        if size:
            yield flat()


def text_grams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct trigrams of each text and how often it holds them: key, gram, n."""
    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("key"), F.lower(text)).mapInArrow(_by_row, f"key {kind}, gram long, n long")
    return found.withColumnRenamed("key", key)


def profile(texts: DataFrame, lang: str, text: str, languages: list[str]) -> DataFrame:
    """Add-one smoothed log probability of every trigram in every language, one row per trigram."""
    wide = materialize(
        text_grams(texts, lang, text).groupBy(lang, "gram").agg(F.sum("n").alias("n")).groupBy("gram").agg(
            *[F.coalesce(F.sum(F.when(F.col(lang) == x, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, x in enumerate(languages)]),
        "gram-counts",
    )
    n = range(len(languages))
    totals = wide.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{i}").alias(f"n_{i}") for i in n]).first()
    return wide.select("gram", *[
        F.log((F.col(f"n_{i}") + 1) / F.lit(float(totals[f"n_{i}"] + totals["v"]))).alias(f"lp_{i}") for i in n
    ])


def detect(texts: DataFrame, key: str, text: str, model: DataFrame, languages: list[str]) -> DataFrame:
    """Most likely language of each text. Scores are summed before the shuffle, so it moves one row per text."""
    if model.count() <= MAX_BROADCAST_GRAMS:
        model = F.broadcast(model)
    scores = text_grams(texts, key, text).join(model, "gram").groupBy(key).agg(
        *[F.sum(F.col(f"lp_{i}") * F.col("n")).alias(f"s_{i}") for i in range(len(languages))])
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{i}").alias("s"), F.lit(x).alias("x")) for i, x in enumerate(languages)]))
    return scores.select(key, best["x"].alias("detected"))


def consistency(texts: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """Share of texts per language whose detected language is the expected one."""
    texts = spread(texts)
    languages = [r[0] for r in texts.select(lang).distinct().orderBy(lang).collect()]  # a handful of language codes
    found = detect(texts, key, text, profile(texts, lang, text, languages), languages)
    judged = texts.select(key, lang, F.length(text).alias("len")).join(found, key, "left")
    ok = (F.col("len") <= SHORT_TEXT) | F.coalesce(F.col("detected") == F.col(lang), F.lit(False))
    return judged.groupBy(lang).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")) * 100, 1).alias("percent_consistent"))
