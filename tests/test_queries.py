"""Every registered query against its SQL."""

from pathlib import Path

import pytest

from corpusloom import registry

from .compare import connect, rows

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, con, sf_dir):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_the_rest_is_tested_by_hand():
    """Queries without SQL are compared with plain Python in test_brute and test_composites."""
    text = "".join((Path(__file__).parent / f"{name}.py").read_text() for name in ("test_brute", "test_composites"))
    assert not [name for name in QUERIES.keys() - ORACLES.keys() if f'"{name}"' not in text]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
