"""Every query of the library against its SQL on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry
from medweave.bindings import load
from tests.compare import differences, duck

QUERIES, ORACLE = load()
FOLDER = "/root/testdata/sf0.001"
# Rows of everything in one task, all pairs of two sides, or rows handed to Python.
UNWANTED = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas|Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = ORACLE.get(name)
    assert sql is not None, "every query here can be written in SQL"
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not UNWANTED.search(plan), plan
    problem = differences(df, con, sql)
    assert problem in (None, "no rows"), problem


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "person_id" and df.count() > 0
