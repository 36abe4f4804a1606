"""Registered queries against their SQL on the smallest driver tables, and the shape of their plans."""

from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402
from joblode.plans.listing_view import TABLES  # noqa: E402
from joblode.plans.oracle import ORACLE  # noqa: E402
from joblode.session import shared_folder  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")

QUERIES = driver.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert Counter(tuple(row[n] for n in names) for row in frame.collect()) == Counter(cursor.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"name", "count"}


@pytest.mark.parametrize("name", ["dedupe_url", "top_skills", "candidate_match", "skills_gap", "norm_skills", "event_rate_cap"])
def test_plans_hold_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_insights_read_only_what_they_need(spark):
    plan = QUERIES["top_companies"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_name" not in plan.split("Relation")[0] and "l_extendedprice" not in plan.split("Relation")[0]


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
