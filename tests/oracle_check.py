"""Compare a registered query with its SQL on the same tables, value by value."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        (tuple(plain(row[i]) for i in order), tuple(type(row[i]).__name__ for i in order)) for row in rows
    )


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, else what differs."""
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    wanted = rows_of([c[0] for c in result.description], result.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} vs {wanted[0]}"
    if found[1] == wanted[1]:
        return None
    extra, missing = found[1] - wanted[1], wanted[1] - found[1]
    return (
        f"rows {sum(found[1].values())} vs {sum(wanted[1].values())}, columns {found[0]}, "
        f"only here {list(extra)[:2]}, only in SQL {list(missing)[:2]}"
    )
