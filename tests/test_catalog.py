import os

import duckdb
import pytest

from quillspan.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns
        return
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    r = c.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    plain = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v
    at = [r.columns.index(k) for k in cols]
    assert sorted(repr([plain(x[k]) for k in cols]) for x in rows) == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
