"""Run registered queries next to their DuckDB twins and report differences.

usage: python tools/check_oracles.py SF_DIR [key-prefix ...]
"""

from __future__ import annotations

import importlib
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from clientpulse.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, float) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark_rows, duck_rows):
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main():
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "10g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    module = next((w[1:] for w in wanted if w.startswith("@")), None)
    prefixes = tuple(w for w in wanted if not w.startswith("@"))
    if module:
        queries = {q.key: q for q in importlib.import_module(f"clientpulse.catalog.{module}").QUERIES}
    else:
        queries = importlib.import_module("clientpulse.catalog").all_queries()
    con, failed = duck(sf), 0
    for key, query in queries.items():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query.run(spark, sf)
            got = rows_of(df.columns, df.collect())
            spent, sql = time.time() - start, query.oracle()
            if sql is None:
                verdict = None
                note = f"rows only: {len(got)} e.g. {got[:1]}"
            else:
                rel = con.execute(sql)
                names = [d[0] for d in rel.description]
                want = rows_of(names, rel.fetchall())
                verdict = compare(got, want) if sorted(names) == sorted(df.columns) else f"columns {names} {df.columns}"
                note = f"{len(got)} rows"
                if not got:
                    note += "  EMPTY"
        except Exception as e:
            verdict, spent = f"{type(e).__name__}: {str(e)[:600]}", time.time() - start
            note = ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {key} {spent:.2f}s {note} {verdict or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
