"""Run catalog queries and their SQL twins on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value: object) -> object:
    if isinstance(value, float):
        # -0.0 and 0.0 are the same.
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare(frame: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs: schema, number of rows, rows. Empty if all agree."""
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = bag(columns, result.fetchall())
    got = bag(frame.columns, [tuple(r) for r in frame.collect()])
    problems = []
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} expected {sorted(columns)}"]
    for name, kind in frame.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} expected {kinds[name]}")
    if expected.total() != got.total():
        problems.append(f"{got.total()} rows expected {expected.total()}")
    surplus, missing = got - expected, expected - got
    if surplus or missing:
        problems.append(f"{surplus.total()} rows differ")
        problems += [f"  got      {r}"[:700] for r in list(surplus)[:2]]
        problems += [f"  expected {r}"[:700] for r in list(missing)[:2]]
    return problems


def check(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, list[str]]:
    from feedlode.plans.catalog import QUERIES
    from feedlode.plans.twins import SQL

    connection = connect(sf_dir)
    return {
        name: compare(query(spark, sf_dir), SQL[name], connection)
        for name, query in QUERIES.items()
        if name in SQL and (not names or name in names)
    }
