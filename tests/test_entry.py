import duckdb
import pytest

import __spark_entry__
from quillmesh.plans import queries as plans

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracles_at_the_smallest_size(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    r = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str([rounded(x[c]) for c in names]) for x in df.collect())
    assert got == sorted(str(list(map(rounded, x))) for x in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
