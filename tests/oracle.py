"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return str(v)[:19] if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, folder: str) -> list:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(found.columns, found.fetchall())
    return [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b] + ([] if len(ours) == len(theirs) else [(len(ours), len(theirs))])
