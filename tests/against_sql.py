"""Comparing a query's rows with another engine's, values rounded, order aside."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([_plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (np.isscalar(v) and pd.isna(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return repr(round(float(v), 6))
    return str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None))


def same(spark, query, sql):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours, theirs = _rows(query(spark, SF).toPandas()), _rows(con.sql(sql).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
