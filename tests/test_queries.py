import pytest
from compare import oracle, rows

from trackloom import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got)  # these are held against plain loops in test_tracks.py
        return
    want = oracle(plans.ORACLE_SQL[name], FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))
