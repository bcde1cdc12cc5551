"""Each query of the package against its SQL twin on the smallest tables."""

import pytest

from groundwork.plans import LANES
from tests.compare import same

EVERY = [(n, f, lane.ORACLE.get(n)) for lane in LANES for n, f in lane.QUERIES.items()]


@pytest.mark.parametrize("name, f, sql", EVERY, ids=[n for n, _, _ in EVERY])
def test_query(spark, sf_dir, duck, name, f, sql):
    df = f(spark, sf_dir)
    if sql is None:
        assert df.count() >= 0
    else:
        same(df, duck, sql)


def test_names_are_unique():
    names = [n for n, _, _ in EVERY]
    assert len(names) == len(set(names))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "item_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
