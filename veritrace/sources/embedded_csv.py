"""Event logs embedded in free text: a preamble, the exact header line, then quoted CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions.text import strip
from veritrace.schemas import CSV_EVENT, CSV_HEADER

_HEADER = ",".join(f'(?:"{name}"|{name})' for name in CSV_HEADER)
# A record runs to the next line break outside quotes; doubled quotes are two adjacent quoted stretches.
_RECORD = r'(?:[^"\r\n]++|"[^"]*+")++'


def has_header(text: Column) -> Column:
    return text.rlike(rf"(?:^|[\r\n]){_HEADER}(?:[\r\n]|$)")


def body(text: Column) -> Column:
    """Everything after the first header line."""
    return F.regexp_extract(text, rf"(?s)^(?:.*?[\r\n])??{_HEADER}(?:\r\n|\r|\n)(.*)", 1)


def parse_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per CSV record after the header. Each text is parsed where it lies; nothing is shuffled."""
    trimmed = strip(F.col(text))
    rows = texts.where(has_header(trimmed)).select(
        key, F.posexplode(F.regexp_extract_all(body(trimmed), F.lit(_RECORD), 0)).alias("line_no", "record")
    )
    parsed = rows.withColumn("r", F.from_csv("record", CSV_EVENT, {"quote": '"', "escape": '"', "multiLine": "true"}))
    return parsed.select(
        key, "line_no", "r.case_id", F.col("r.step").try_cast("int").alias("step"), "r.activity", "r.description", "record"
    )


def events(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Well-formed event rows."""
    return parse_rows(texts, key, text).where(F.col("step").isNotNull() & F.col("activity").isNotNull())


def rejects(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of texts without a header, once each, and records without a step or an activity, with the reason."""
    no_header = texts.where(~F.coalesce(has_header(strip(F.col(text))), F.lit(False))).select(
        key, F.lit(-1).alias("line_no"), F.lit("no header").alias("reason")
    ).distinct()
    bad_rows = parse_rows(texts, key, text).where(F.col("step").isNull() | F.col("activity").isNull()).select(
        key, "line_no", F.lit("bad row").alias("reason")
    )
    return no_header.unionByName(bad_rows)
