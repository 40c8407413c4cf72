"""Ordering inside groups: the chunked plan for hot keys equals the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from veritrace.operators.ordering import dense_index, measure_skew, order_within, running_max_within


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; positions are shuffled and unevenly spread."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, int(rng.random() ** 3 * 10_000), i, rng.choice("abc")))
    return spark.createDataFrame(rows, "k string, pos long, tie long, v string").repartition(6)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["k"], []).append(r)
    out = {}
    for group in groups.values():
        group.sort(key=lambda r: (r["pos"], r["tie"]))
        for i, r in enumerate(group):
            out[r["tie"]] = (i + 1, group[i + 1]["v"] if i + 1 < len(group) else None)
    return out


@pytest.mark.parametrize("max_rows", [10_000, 50, 7])
def test_order_within(spark, skewed, max_rows):
    got = order_within(skewed, ["k"], ["pos", "tie"], ["v"], max_rows=max_rows).collect()
    assert {r["tie"]: (r["rn"], r["next_v"]) for r in got} == brute(skewed.collect())


@pytest.mark.parametrize("max_rows", [10_000, 20])
def test_running_max(spark, skewed, max_rows):
    got = running_max_within(skewed, ["k"], ["pos", "tie"], {"m": F.struct("v", "tie")}, max_rows).collect()
    best = {}
    for r in sorted(got, key=lambda r: (r["k"], r["pos"], r["tie"])):
        best[r["k"]] = max(best.get(r["k"], ("", -1)), (r["v"], r["tie"]))
        assert tuple(r["m"]) == best[r["k"]]


def test_hot_key_is_cut_into_many_chunks(spark, skewed):
    from veritrace.operators.ordering import cut_hot_keys

    cut = cut_hot_keys(skewed, ["k"], ["pos", "tie"], max_rows=50)
    sizes = {r["_chunk"]: r["count"] for r in cut.rows.where("k = 'hot'").groupBy("_chunk").count().collect()}
    assert len(sizes) >= 5 and max(sizes.values()) <= 100
    assert measure_skew(skewed, ["k"], 50).n_hot == 1


def test_dense_index_is_gap_free(spark, skewed):
    got = dense_index(skewed, ["pos", "tie"], index="id").collect()
    want = sorted(skewed.collect(), key=lambda r: (r["pos"], r["tie"]))
    assert [r["tie"] for r in sorted(got, key=lambda r: r["id"])] == [r["tie"] for r in want]
    assert sorted(r["id"] for r in got) == list(range(len(want)))
