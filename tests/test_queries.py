"""Every query against its SQL in DuckDB, over the smallest test tables."""

import duckdb
import pytest

from trigrail import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", q.queries())
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = q.queries()[name](spark, SF)
    want = duck.execute(q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_compaction_counts_a_path_once(spark, duck, tmp_path):
    """Pages of which some share an address: num_files is of paths, num_occurrences of files."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = pages.where("page_id % 7 = 0").selectExpr("page_id + 1000 AS page_id", "url", "html")
    pages.unionByName(more).write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = q.queries()["compaction"](spark, str(tmp_path)), con.execute(q.oracle_sql()["compaction"])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
