"""Order-insensitive comparison of a Spark result with a SQL result."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def sql_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def sql_result(con, statement: str):
    cursor = con.execute(statement)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def differences(spark_df, con, statement: str) -> list[str]:
    """Human-readable differences, empty if both results hold the same rows."""
    columns, rows = sql_result(con, statement)
    if sorted(columns) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(spark_df.columns)} / {sorted(columns)}"]
    ours = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = normal_rows(columns, rows)
    if len(ours) != len(theirs):
        return [f"row counts differ: {len(ours)} / {len(theirs)}", f"{ours[:2]} / {theirs[:2]}"]
    return [f"{a} / {b}" for a, b in zip(ours, theirs) if a != b]
