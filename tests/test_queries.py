import pytest

from mosaique.plans import catalogue
from tests.oracle import SF, check


@pytest.mark.parametrize("name", catalogue.oracle_sql() | catalogue.slow_sql())
def test_same_rows_as_sql(spark, name):
    check(spark, catalogue.queries()[name], (catalogue.oracle_sql() | catalogue.slow_sql())[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 1000 and min(r["seg_id"] for r in rows) == 1
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_stitched_ids_have_no_gaps(spark):
    ids = sorted(r["seg_id"] for r in catalogue.queries()["segment_tiled"](spark, SF).select("seg_id").distinct().collect())
    assert ids == list(range(ids[0], ids[0] + len(ids))) and ids[0] in (0, 1)
