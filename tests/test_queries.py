"""Every query with SQL against DuckDB; the others make their rows."""

import datetime

import duckdb
import pytest

from kinetra.plans import evaluation, models, signals, tables  # noqa: F401
from kinetra.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return repr(round(float(v), 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    """Whole results; their values are held against plain versions in test_query_values.py."""
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len(rows[0]) == len(QUERIES[name](spark, SF).columns)


def test_studies_take_all_subjects(spark):
    want = {r[0] for r in models._windows(spark, SF).where("y > 0").select("subject_id").distinct().collect()}
    got = [r.subject_id for r in QUERIES["ex1_leave_one_subject_out"](spark, SF).collect()]
    assert set(got) == want and len(got) == 4 * len(want)
