"""Rows of a query against its SQL, as multisets."""

import os


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        p = os.path.join(folder, f)
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)) and float(v).is_integer():
        return int(v)
    return v.item() if isinstance(v, np.generic) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in pdf[cols].itertuples(index=False, name=None))
