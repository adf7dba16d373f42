import duckdb
import pytest

from sparkloom.plans.text_queries import FIXED


@pytest.mark.parametrize("name", sorted(FIXED))
def test_as_in_sql(spark, name):
    """Errors, an oscillation up to the cap, and ranks cut off by theirs, for inputs that no table holds."""
    f, sql = FIXED[name]
    frame = f(spark)
    rows = duckdb.connect().sql(f"SELECT {', '.join(frame.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(rows, key=str)
