"""Pair queries list every pair of rows, copies of a shape included."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from groundshift.session import run_dir
from tools.check_oracle import canonical


@pytest.fixture(scope="module")
def copied(spark):
    """Forty orders of 60 m to 700 m at two places of each of two sectors; each comes three times, under keys that keep its place."""
    where = run_dir(spark, "copied")
    orders = [(60 * n + 2400 * c, n % 4 + 50 * c, 3600.0 + 12000.0 * n, "1-URGENT", "O", datetime(1998, 2, 6)) for n in range(40) for c in range(3)]
    customers = [(n + 50 * c, n % 2) for n in range(4) for c in range(3)]
    for name, rows, columns in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string, o_orderdate timestamp"),
        ("customer", customers, "c_custkey long, c_nationkey long"),
        ("nation", [(0, 0), (1, 0)], "n_nationkey long, n_regionkey long"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{where}/{name}.parquet")
    return where


def _same_as_sql(spark, where, name):
    got = entry.queries()[name](spark, where).toPandas()
    con = duckdb.connect()
    for table in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where.removeprefix('file:')}/{table}.parquet/*.parquet'")
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == ["id_a", "id_b", "iou", "sector_id"]
    assert canonical(got, None) == canonical(exp, None)
    return got


def test_boxes_meet_in_all_their_copies(spark, copied):
    got = _same_as_sql(spark, copied, "join_07")
    assert (got["iou"] == 1.0).sum() == 120 and len(got) > 240  # three pairs of the copies of each box, nine of each pair of boxes


def test_rings_meet_in_all_their_copies(spark, copied):
    got = _same_as_sql(spark, copied, "geo_06")
    assert (got["iou"] == 1.0).sum() == 120 and len(got) > 240
