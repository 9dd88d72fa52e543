"""Every registered query against its DuckDB statement."""

from __future__ import annotations

import compare
import pytest
from helpers import SMALL

import __spark_entry__ as registry
from spillway.catalog import QUERIES
from spillway.catalog.reports import MODELS
from spillway.oracle import STATEMENTS

#: Queries that may well have nothing to report on the smallest data.
MAY_BE_EMPTY = {"rows_without_partner"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_rows_equal(spark, duck, name):
    spark_names, spark_rows = compare.spark_rows(QUERIES[name](spark, SMALL))
    duck_names, duck_rows = compare.duck_rows(duck, STATEMENTS[name])
    assert spark_names == duck_names
    assert spark_rows == duck_rows
    assert spark_rows or name in MAY_BE_EMPTY


def test_flagship(spark):
    assert registry.entry(spark).count() == 5


def test_every_query_has_a_statement():
    assert set(QUERIES) - set(MODELS) == set(STATEMENTS)
    assert set(QUERIES) <= set(registry.queries())
    assert set(STATEMENTS) <= set(registry.oracle_sql())


def test_the_broken_book_breaks_every_kind_of_rule(spark):
    counts = {r["rule"].split("(")[0] for r in QUERIES["dq_broken_book"](spark, "/root/testdata/sf0.01").where("violations > 0").collect()}
    assert counts == {"not_null", "in_range", "one_of", "unique", "references"}
