"""Run the registered queries beside their SQL: python -m suite.compare [folder] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

from gaugeline.session import build_session
from suite import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("string", "str")):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what differs first."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} | {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} | {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        numeric = pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c])
        x, y = (a[c].astype(float), b[c].astype(float)) if numeric else (a[c], b[c])
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{c}: {int((~same).sum())} differ, first at {i}:\n{a.iloc[i].to_dict()}\n{b.iloc[i].to_dict()}"
        kinds = {str(a[c].dtype).lower().rstrip("_0123456789"), str(b[c].dtype).lower().rstrip("_0123456789")}
        if len(kinds) > 1 and not a[c].isna().any():
            return f"{c}: types {a[c].dtype} | {b[c].dtype}"
    return None


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = []
    for word in argv[1:] or ["@"]:
        # "@series" stands for all queries of that file.
        names += [n for n, (fn, _) in CATALOGUE.items() if fn.__module__.split(".")[-1].startswith(word[1:])] if word[0] == "@" else [word]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in names:
        fn, sql = CATALOGUE[name]
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            note = None
            if sql is not None:
                start = time.time()
                note = difference(got, con.execute(sql).df())
                took_sql = f"{time.time() - start:5.1f}"
            else:
                took_sql = "    -"
        except Exception as error:  # noqa: BLE001
            took, took_sql = time.time() - start, "    -"
            note = f"{type(error).__name__}: {str(error)[:1500]}"
            traceback.print_exc(limit=-4)
        print(f"{'ok ' if note is None else 'BAD'} {name:28s} {took:6.1f}s sql {took_sql} {note or f'{len(got)} rows'}", flush=True)
        if note:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} good", "" if not bad else f"bad: {' '.join(bad)}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
