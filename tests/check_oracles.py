"""Compare every registered query with its SQL on the same tables: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if value is None:
        return ("", "NULL")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return ("n", "nan" if math.isnan(number) else repr(round(number, 6) + 0.0))
    if isinstance(value, (list, tuple)):
        return ("l", tuple(canonical(v) for v in value))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, queries, oracles):
    """Empty text when the results agree, else what differs."""
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return "" if got[1] else "no rows"
    cursor = con.execute(oracles[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        in_got, in_want = set(got[1]), set(want[1])
        only_got = [r for r in got[1] if r not in in_want][:3]
        only_want = [r for r in want[1] if r not in in_got][:3]
        return f"rows {len(got[1])} vs {len(want[1])}\n   spark {only_got}\n   sql   {only_want}"
    return "" if got[1] else "both empty"


if __name__ == "__main__":
    from veritrace.plans import catalog
    from veritrace.session import build_session

    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    names = sys.argv[2:] or list(catalog.QUERIES)
    bad = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, catalog.QUERIES, catalog.ORACLES)
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:600]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.2f}s {problem}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
