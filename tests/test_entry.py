import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank", "rule_number", "section_title", "source_path", "snippet"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())))
def test_query_equals_its_sql(spark, name):
    import glob

    import duckdb

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(SF + "/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
        r = con.execute(entry.oracle_sql()[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert sorted(tuple(show(x[names.index(c)]) for c in cols) for x in r.fetchall()) == got
