"""Event-log typing, profiling, traces, directly-follows graphs and log-level relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions.text import let
from veritrace.operators.ordering import MAX_ROWS_PER_TASK, KeySkew, order_within, per_key
from veritrace.schemas import END, START

#: Events kept in one trace row; a longer case continues in further rows, numbered by ``part``.
TRACE_PART = 10_000


def typed(log: DataFrame) -> DataFrame:
    """Case id as text, step as integer and as seconds since the epoch, activity as text."""
    return log.withColumns({
        "case_id": F.col("case_id").cast("string"),
        "step": F.col("step").try_cast("int"),
        "ts": F.timestamp_seconds(F.col("step").try_cast("int")),
        "activity": F.col("activity").cast("string"),
    })


def require_columns(log: DataFrame, *names: str) -> None:
    """Fail on the driver, before any job runs, when a log lacks a column."""
    missing = [n for n in names if n not in log.columns]
    if missing:
        raise ValueError(f"event log lacks columns {missing}")


def profile(log: DataFrame) -> DataFrame:
    """Row, case and per-column NULL counts of a log."""
    return log.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("case_id").alias("n_cases"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("case_id", "step", "activity")],
    )


def traces(log: DataFrame, part_size: int = TRACE_PART) -> DataFrame:
    """Activities of a case in step order, at most ``part_size`` per row. Steps must be dense from 1."""
    part = F.floor((F.col("step") - 1) / part_size).cast("int")
    return (
        log.groupBy("case_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("step", "activity"))).alias("events"))
        .select("case_id", "part", F.transform("events", lambda e: e["activity"]).alias("trace"))
    )


def directly_follows_rows(
    log: DataFrame, keys: list[str], order: list[str], max_rows: int = MAX_ROWS_PER_TASK,
    co_locate: list[str] | None = None, skew: KeySkew | None = None,
) -> DataFrame:
    """One row per transition of each group, with the artificial start and end nodes.

    Every event yields the edge to its successor (or to the end node); the first event also yields the edge
    from the start node. Both come from one ordered pass.
    """
    ordered = order_within(log, keys, order, next_of=["activity"], max_rows=max_rows, co_locate=co_locate, skew=skew)
    step_edge = F.struct(
        F.col("activity").alias("src"), F.coalesce("next_activity", F.lit(END)).alias("dst")
    )
    start_edge = F.struct(F.lit(START).alias("src"), F.col("activity").alias("dst"))
    edges = F.when(F.col("rn") == 1, F.array(start_edge, step_edge)).otherwise(F.array(step_edge))
    return ordered.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.src", "e.dst")


def dfg_by_case(log: DataFrame, order: list[str] = ("step",), max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Directly-follows graph of every case: the process model as an edge table."""
    def edges(part: DataFrame, skew: KeySkew) -> DataFrame:
        rows = directly_follows_rows(part, ["case_id"], list(order), max_rows, skew=skew)
        return rows.groupBy("case_id", "src", "dst").agg(F.count(F.lit(1)).alias("cnt"))

    return per_key(log, ["case_id"], max_rows, edges)


def dfg(log: DataFrame, order: list[str] = ("step",), max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Directly-follows graph of the whole log."""
    rows = directly_follows_rows(log, ["case_id"], list(order), max_rows)
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def start_end_activities(log: DataFrame) -> DataFrame:
    """How many cases start and end with each activity. First and last are plain aggregates."""
    ends = log.groupBy("case_id").agg(
        F.min_by("activity", "step").alias("start"), F.max_by("activity", "step").alias("end")
    )
    return (
        ends.select(F.explode(F.array(
            F.struct(F.lit("start").alias("position"), F.col("start").alias("activity")),
            F.struct(F.lit("end").alias("position"), F.col("end").alias("activity")),
        )).alias("p"))
        .groupBy("p.position", "p.activity")
        .agg(F.count(F.lit(1)).alias("n_cases"))
    )


def variant_keys(log: DataFrame) -> DataFrame:
    """A fingerprint of each case's trace.

    Two sums of hashes of (step, activity) keep the order and count repeated rows, and need no collected array, so they
    partially aggregate on the map side whatever the length of a case.
    """
    return log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.xxhash64("step", "activity").cast("decimal(20,0)")).alias("h1"),
        F.sum(F.xxhash64("activity", "step", F.lit("v")).cast("decimal(20,0)")).alias("h2"),
    )


def variants(log: DataFrame) -> DataFrame:
    """Distinct traces, how many cases follow each and the smallest case id that does."""
    per_case = variant_keys(log)
    return per_case.groupBy("n_events", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("case_id").alias("first_case")
    )


def footprint(edges: DataFrame) -> DataFrame:
    """Relation of every ordered pair of activities from a log-level edge table.

    The edge table has at most |activities|^2 rows, so pairing it with itself stays bounded by the vocabulary.
    """
    inner = edges.where((F.col("src") != START) & (F.col("dst") != END)).select("src", "dst")
    both = inner.select("src", "dst", F.lit(1).alias("fwd"), F.lit(0).alias("bwd")).unionByName(
        inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("fwd"), F.lit(1).alias("bwd"))
    )
    seen = both.groupBy("src", "dst").agg(F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd"))
    nodes = (
        edges.select(F.explode(F.array("src", "dst")).alias("activity"))
        .where(~F.col("activity").isin(START, END))
        .agg(F.array_sort(F.collect_set("activity")).alias("all"))
    )
    grid = nodes.select(F.explode("all").alias("src"), "all").select("src", F.explode("all").alias("dst"))
    relation = (
        F.when((F.col("fwd") == 1) & (F.col("bwd") == 1), "‖")
        .when(F.col("fwd") == 1, "→")
        .when(F.col("bwd") == 1, "←")
        .otherwise("#")
    )
    return grid.join(seen, ["src", "dst"], "left").select("src", "dst", relation.alias("relation"))


def lines_to_steps(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-blank line, numbered 01, 02, ... within its text. No shuffle: a line stays with its row."""
    lines = F.filter(F.split(F.col(text), "\\r\\n|\\r|\\n"), lambda s: s.rlike(r"\S"))
    numbered = texts.select(key, F.posexplode(lines).alias("pos", "line"))
    number = F.col("pos") + 1
    return numbered.select(
        key,
        number.alias("step_no"),
        F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")).alias("step"),
        "line",
    )


def text_transitions(
    texts: DataFrame, key: str, text: str, label: Callable[[Column], Column]
) -> DataFrame:
    """Transitions of the labelled lines of each text, start and end nodes included.

    The lines of a text are already in order, so consecutive labels pair up inside the row: no window, no shuffle.
    """
    return texts.select(key, F.explode(transition_array(F.col(text), label)).alias("e")).select(key, "e.src", "e.dst")


def transition_array(text: Column, label: Callable[[Column], Column]) -> Column:
    """The transitions of one text in order, as structs of src and dst; NULL without a line."""
    labels = F.transform(F.filter(F.split(text, "\\r\\n|\\r|\\n"), lambda s: s.rlike(r"\S")), label)
    def edges(nodes: Column) -> Column:
        arrows = F.zip_with(
            F.concat(F.array(F.lit(START)), nodes), F.concat(nodes, F.array(F.lit(END))),
            lambda a, b: F.struct(a.alias("src"), b.alias("dst")),
        )
        return F.when(F.size(nodes) > 0, arrows)

    # Bound once: a label is computed a single time although every inner label ends one edge and starts the next.
    return let(labels, edges)


def label_by_rules(line: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule of which a word or phrase occurs in the line names its activity.

    One pass over the line finds all words of all rules, whatever their order; the lowest rule number among them wins. No
    phrase of a rule may hold a word of another, as found words do not overlap.
    """
    ranks = {phrase: i for i, (phrases, _) in reversed(list(enumerate(rules))) for phrase in phrases.split("|")}
    words = "|".join(sorted(ranks, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(line), F.lit(rf"\b({words})\b"), 1)
    number = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    best = F.array_min(F.transform(found, lambda w: F.element_at(number, w)))
    labels = F.array(*[F.lit(label) for _, label in rules])
    return F.coalesce(F.get(labels, best), F.lit(default))
