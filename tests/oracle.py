"""Compare registered queries with their SQL on the same tables.

    python tests/oracle.py sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TO_SQL = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
        elif pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "isoformat") else v)
    return pdf.sort_values(list(pdf.columns), na_position="first", kind="stable").reset_index(drop=True)


def compare(name: str, df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where rows, types and values agree, else what differs."""
    got_types = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if got_types != want_types:
        both = set(got_types.items()) ^ set(want_types.items())
        return f"types: {sorted(both)}"
    got, want = ordered(df.toPandas()), ordered(rel.df())
    if len(got) != len(want):
        return f"rows: {len(got)} and {len(want)}"
    if not len(got):
        return "no rows"
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} of {len(got)} values of {c}, first {got.loc[i].to_dict()} and {want.loc[i].to_dict()}"
    return None


def plan_flags(df) -> list[str]:
    """Plan nodes that do not scale with the data: products of two sides, and
    windows over a single partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    flags = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in plan]
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and any("Window" in above for above in lines[max(0, i - 4):i]):
            flags.append("Window on one partition")
    return flags


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from sungrid.session import local_session

    sf_dir = f"/root/testdata/{argv[0]}"
    spark, con, bad = local_session(), connect(sf_dir), 0
    todo = argv[1:] or list(queries())
    for name in todo:
        start, flags = time.time(), []
        try:
            df, sql = queries()[name](spark, sf_dir), oracle_sql().get(name)
            problem = compare(name, df, con, sql) if sql else (None if df.toPandas().shape[0] else "no rows")
            flags = plan_flags(df)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''} {flags or ''}", flush=True)
    print(f"{len(todo) - bad} of {len(todo)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
