"""Every registered query of the posting engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from jobscope.plans import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registered.ORACLES) <= set(registered.QUERIES) <= set(__spark_entry__.queries())


CASES = {name: (registered.QUERIES[name], sql) for name, sql in registered.ORACLES.items()} | registered.EXAMPLES


@pytest.mark.parametrize("name", sorted(CASES))
def test_equal_to_sql(spark, duck, tmp_path, name):
    query, sql = CASES[name]
    query(spark, SF).write.parquet(f"{tmp_path}/out")
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    duck.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(duck.table("want").columns)
    assert columns == sorted(duck.table("got").columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []


def test_full_and_native_unescape_agree_on_pages(spark):
    native, full = (registered.QUERIES[n](spark, SF) for n in ("normalize_pages", "normalize_pages_full"))
    assert native.exceptAll(full).isEmpty() and full.exceptAll(native).isEmpty()


def test_digest_messages_fit(spark):
    rows = registered.QUERIES["digest_pack"](spark, SF).collect()
    assert rows and all(r.chars <= 4096 for r in rows)


def test_flagship_plan_is_a_top_k_with_pruned_columns(spark):
    plan = registered.QUERIES["list_default"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "Python" not in plan
