"""Compare queries with their oracle SQL: python tests/check_oracle.py [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for col in frame.columns:
        if frame[col].dtype == object:
            frame[col] = frame[col].map(lambda v: None if v is None or v is pd.NA else str(v))
        elif str(frame[col].dtype).startswith("float"):
            frame[col] = frame[col].map(lambda v: None if pd.isna(v) else repr(float(v))).astype(object)
        else:
            frame[col] = frame[col].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    frame = frame.fillna("\0null")
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return "ok"
    rows = (a != b).any(axis=1)
    at = rows.idxmax()
    return f"{int(rows.sum())} rows differ, first:\n  spark {a.loc[at].to_dict()}\n  duck  {b.loc[at].to_dict()}"


def types_of(spark_df, rel) -> str:
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    got = {f.name: names.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    want = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return ", ".join(f"{c}: {got[c]}/{want.get(c)}" for c in got if got[c] != want.get(c))


def main() -> int:
    import __spark_entry__ as entry
    from speechmill.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", 8)
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = 0
    for name in names:
        try:
            t0 = time.time()
            df = queries[name](spark, sf_dir)
            got = df.toPandas()
            t1 = time.time()
            note, types = "no oracle", ""
            if name in sql:
                rel = con.sql(sql[name])
                types = types_of(df, rel)
                note = compare(got, rel.df())
            t2 = time.time()
        except Exception as error:  # report and go on
            note, types, t1, t2, got = f"ERROR {type(error).__name__}: {str(error)[:900]}", "", time.time(), time.time(), []
        good = note in ("ok", "no oracle") and not types
        bad += not good
        print(f"{'OK ' if good else 'BAD'} {name}: rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {note} {types}",
              flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
