"""Every registered query against its SQL, over whole tables."""

import pytest

from checks.compare import database, difference
from checks.oracle import all_sql
from checks.queries import all_queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def base():
    return database(SMALL)


def test_names_agree():
    assert set(all_sql()) <= set(all_queries())
    assert set(all_queries()) - set(all_sql()) == {"risk_scores", "model_metrics"}


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_result(spark, base, name):
    assert difference(spark, base, SMALL, name) is None
