"""Fixtures of the operators' tests."""

from __future__ import annotations

import pytest
from llm_helpers import table

from spillway.llm.storage import workers_find_package


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    workers_find_package(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
