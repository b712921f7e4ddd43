import pytest
from compare import same_rows

from newsweave import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    same_rows(Q.QUERIES[name](spark, sf_dir), Q.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).limit(1).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
