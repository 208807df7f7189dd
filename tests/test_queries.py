"""Every registered query against its SQL."""

import pytest

import __spark_entry__
from oracle import compare

SQL = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = compare(spark, duck, QUERIES[name], SQL[name], sf_dir)
    assert len(got) == len(want)
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6)} <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["release_id", "scheme", "edition", "normalized_code", "change"]
