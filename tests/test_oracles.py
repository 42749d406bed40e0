"""Every query that SQL can express gives the rows of its SQL; the others run."""

import pytest

from lexiloom.plans import concepts, extras, learning, mining, problems, relational, terms, trials, views  # noqa: F401
from lexiloom.plans.registry import QUERIES, SQL

from .conftest import DATA, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_problem_queries(spark):
    assert problems.p1_found(spark, DATA).columns == ["tbl", "row_id", "epoch_s"]
    assert problems.p1_found(spark, DATA).count() > 0
    assert problems.p4_found(spark, DATA).columns == ["tbl", "row_key", "pos", "val"]
    assert problems.p4_found(spark, DATA).count() > 0
