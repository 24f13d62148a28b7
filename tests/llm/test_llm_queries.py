"""Every query of the subpackage with SQL gives the rows of its SQL."""

import pytest

from nocturne.llm.queries import oracle_sql, queries

from ..conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())
