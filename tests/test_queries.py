"""Every query gives the rows of its SQL, or runs where SQL cannot say it."""

import pytest

from lexloom import catalogue
from oracle import spark_rows, sql_rows

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert (names, rows) == sql_rows(ORACLES[name], sf_dir)
    else:
        assert names
