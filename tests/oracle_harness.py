"""Local stand-in for the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and an order-insensitive hash of
the values.
"""

from __future__ import annotations

import glob
import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].astype(object).itertuples(index=False):
        rows.append(repr(tuple(_norm(None if (not isinstance(x, (list, dict)) and pd.isna(x))
                                     else x) for x in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict):
    s_pdf = queries[name](spark, sf_dir).toPandas()
    o_pdf = duck(sf_dir).execute(oracles[name]).df()
    return frame_digest(s_pdf), frame_digest(o_pdf), s_pdf, o_pdf


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def type_diffs(spark_df, duck_rel) -> list:
    """Columns whose Spark type does not map to the oracle's DuckDB type."""
    st = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    dt = dict(zip(duck_rel.columns, [str(t) for t in duck_rel.types]))
    return [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt))
            if SPARK_TO_DUCK.get(st.get(c), st.get(c)) != dt.get(c)]
