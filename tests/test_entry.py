import duckdb
import pytest

import __spark_entry__

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All queries with SQL, and one of each kind at another size.
ALL = [(name, SMALL) for name in sorted(__spark_entry__.oracle_sql())]
SOME = [(name, LARGER) for name in ("merge_accepted", "local_state", "diff_replicas", "text_merge_auto", "list_insert", "store_changes_since")]


def test_entry_and_names(spark):
    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "size"), ALL + SOME)
def test_query_equals_its_sql(spark, name, size):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{size}/{t}.parquet'")
    ours = __spark_entry__.queries()[name](spark, size)
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in ours.columns]
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())
