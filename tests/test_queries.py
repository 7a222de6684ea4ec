"""Every registered query outside the llm subpackage against its SQL, or at least to its end."""

import pytest

from skeinworks.plans import registry
from tests.support import DATA, database, same

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    if name in ORACLE:
        same(spark, QUERIES[name], ORACLE[name], db)
    else:
        assert QUERIES[name](spark, DATA).columns
        QUERIES[name](spark, DATA).collect()


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


def test_transpose_whole(spark, db):
    """Every position of every embedding comes out."""
    n, total = db.sql("SELECT max(len(embedding)), sum(len(embedding)) FROM embeddings").fetchall()[0]
    done = QUERIES["transpose_long_all"](spark, DATA)
    assert {r["pos"] for r in done.select("pos").distinct().collect()} == set(range(n)) and done.count() == total


def test_sales_whole(spark, db):
    """Every amount comes out under its kind of payment, up to the rounding of each cell."""
    want = dict(db.sql("SELECT transmode, sum(CAST(amount AS DOUBLE)) FROM superannuated1909 WHERE date IS NOT NULL GROUP BY 1").fetchall())
    rows = QUERIES["sales_resample_pivot_sum_all"](spark, DATA).collect()
    assert all(abs(sum(r[f"amount_{m}"] for r in rows) - x) <= 0.051 * len(rows) for m, x in want.items())
