"""Every registered query against its SQL twin, and the shape of some plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from feedlode.plans import catalog
from feedlode.plans.tables import AS_OF
from feedlode.plans.twins import SQL
from feedlode.schema import RAW_SCHEMA
from feedlode.sources.payloads import parse_atom
from tests.compare import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_sql(spark, tables, name):
    assert name in SQL
    assert compare(catalog.QUERIES[name](spark, SMALL), SQL[name], tables) == []


def test_contract(spark):
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    latest = plan(catalog.latest_insights(spark, SMALL))
    assert "TakeOrderedAndProject" in latest
    for query in (catalog.analyze_heuristic, catalog.assign_clusters, catalog.embedding_text):
        assert "Python" not in plan(query(spark, SMALL))
    stats = plan(catalog.insight_stats(spark, SMALL))
    # Only the columns that count are read, and the rows once.
    assert stats.count("FileScan") == 1 and "props" not in stats
    # Each payload is read once, and not carried along with every entry.
    raw = spark.createDataFrame([], RAW_SCHEMA)
    atom = plan(parse_atom(raw, AS_OF, ["a"]).posts)
    assert atom.count("from_xml") == 1
    spread = [line for line in atom.splitlines() if "Generate explode" in line]
    assert all("_read" not in line.split("END), ")[1] for line in spread)
