"""Every query of the library against its SQL at the smallest scale, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from copycensus.plans.oracles import ORACLES as SQL
from copycensus.plans.queries import REGISTRY as QUERIES

SF = "/root/testdata/sf0.001"
# An iterative fit has no SQL equivalent.
ROWS_ONLY = {"ml_condition_scores"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


def test_contract_holds_the_library():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 6


def test_regression_scores_every_evaluation_row(spark):
    rows = QUERIES["ml_condition_scores"](spark, SF).collect()
    assert len(rows) == 3 and len({r["evaluation_images"] for r in rows}) == 1


def test_extremes_are_of_two_studies(spark):
    rows = QUERIES["study_contrast_extremes"](spark, SF).collect()
    assert {r["studies"] for r in rows} == {2} and any(r["minimum_mean_pp"] < r["maximum_mean_pp"] for r in rows)
