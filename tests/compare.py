"""Comparison of a query's rows with those of its SQL."""

from pathlib import Path

import duckdb
import numpy as np

SMALL = "/root/testdata/sf0.001"


def text(v):
    if v is None or isinstance(v, float) and np.isnan(v) or str(v) in ("NaT", "<NA>"):
        return ""
    if isinstance(v, (float, np.floating)):
        return f"{v:.6f}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


def oracle(sql, sf=SMALL):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con.execute(sql).df()
