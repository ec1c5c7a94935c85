"""Every registered query of the engine against DuckDB on the small tables."""

import threading

import duckdb
import pytest

from kinfold.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    rows = con.sql(f"select {listed} from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


def test_scan_plan_is_one_pass_without_python(spark, sf):
    """Membership building reads the table once, prunes columns and stays in generated code."""
    plan = QUERIES["membership_explode"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Exchange" not in plan
    assert "p_retailprice" not in plan


def _chains(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return QUERIES["overlap_no_closure"](spark, str(tmp_path)).select("a", "c")


def test_chains_equal_sql_on_odd_rows(spark, tmp_path):
    """Missing keys, blank names, copies, and ids that repeat with other keys."""
    rows = [(None if i == 7 else i % 83, [None, " ", "x", "X ", "y", "z", "w"][i * i % 11 % 7], ["b", "b", None][i * 5 % 13 % 3], "t", i * i * 3 % 17 % 5) for i in range(120)]
    got = [tuple(r) for r in _chains(spark, tmp_path, rows).collect()]
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got and sorted(got) == sorted(con.sql(f"select a, c from ({ORACLE_SQL['overlap_no_closure']})").fetchall())


def test_chains_of_copies(spark, tmp_path):
    """3,000 copies, a record with their name and one with that one's specification: 3,000 pairs, not 27 billion chains."""
    rows = [(i, "x", "b", "t", 1) for i in range(3000)] + [(3000, "x", "b", "t", 2), (3001, "y", "b", "t", 2)]
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = [tuple(r) for r in _chains(spark, tmp_path, rows).collect()]
    finally:
        late.cancel()
    assert sorted(got) == sorted((str(i), "3001") for i in range(3000))


def test_chains_are_written_small(spark, tmp_path):
    """Two names with 100 specifications in 10 copies each: a start stays for a run of ends, so Parquet needs few bits a pair."""
    rows = [(10 * (100 * n + s) + i, "xy"[n], "b", "t", s) for n in range(2) for s in range(100) for i in range(10)]
    _chains(spark, tmp_path, rows).write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == found.distinct().count() == 2 * 1000 * 990
    assert found.where("(a < 1000) = (c < 1000) or floor(a / 10) % 100 = floor(c / 10) % 100").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * found.count()
