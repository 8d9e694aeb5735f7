"""Compares a query's rows with its SQL's, as multisets, column order aside."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_value(r[k]) for k in order) for r in rows)


def differences(df, con, sql):
    got_columns = df.columns
    relation = con.sql(sql)
    want_columns = relation.columns
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} and {sorted(want_columns)}"
    got, want = rows_of(got_columns, [tuple(r) for r in df.collect()]), rows_of(want_columns, relation.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
    return None
