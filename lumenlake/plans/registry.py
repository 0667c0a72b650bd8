"""Where queries register themselves, with the SQL that an independent engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.sources.catalog import Catalog, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Texts of further views that a query's SQL may name, over the catalog views named before them.
DERIVED: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", rounded: str = "") -> Callable:
    """Register a function of a Catalog; sql may read the named catalog views as well as the plain tables.

    Doubles named in rounded are rounded to six places on both sides, as sums in another order differ in the last bits;
    they are moved by 1e-9 first, since the engines round a half differently.
    """

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir)).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in rounded.split()})
        if sql is not None:
            heads = [f"{v} AS ({DERIVED[v] if v in DERIVED else view_sql(v)})" for v in views.split()]
            body = sql.strip()
            if rounded:
                body = f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in rounded.split())}) FROM ({body})"
            recursive = "RECURSIVE " if "WITH RECURSIVE" in body + "".join(heads) else ""
            ORACLE_SQL[name] = f"WITH {recursive}{', '.join(heads)} SELECT * FROM ({body})" if heads else body
        return f

    return register
