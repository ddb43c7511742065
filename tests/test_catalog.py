"""Every registered query against its DuckDB statement; rows-only where it has none."""

import pytest

from compare import check_connection, difference
from parcelsight.catalog import load
from parcelsight.catalog.registry import run

CATALOG = load()


@pytest.fixture(scope="module")
def duck(folder):
    return check_connection(folder)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, folder, duck, name):
    sql = CATALOG[name][1]
    df = run(name, spark, folder)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, sql) is None
