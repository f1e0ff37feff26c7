"""Registered queries against their SQL, on a tiny star schema."""

import duckdb
import pytest

import __spark_entry__ as entry
from hornbeam import queries as core


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("star")
    put = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{at}/{name}.parquet")
    put("region", [(i, n) for i, n in enumerate(["AFRICA", "ASIA", "EUROPE"])], "r_regionkey int, r_name string")
    put("nation", [(i, f"NATION_{i}", i % 3) for i in range(14)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(i, i % 7, ["A", "B"][i % 2]) for i in range(30)], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("supplier", [(i, (3 * i) % 5) for i in range(8)], "s_suppkey long, s_nationkey int")
    put("part", [(i, f"p{i}", f"b{i % 4}", i % 50 + 1) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_size int")
    put("orders", [(i, i % 20, ["F", "O"][i % 3 == 0]) for i in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string")
    put("lineitem", [(i % 60, i % 8, 45.0 + i % 6, 0.1 * (i % 2)) for i in range(120)], "l_orderkey long, l_suppkey long, l_quantity double, l_discount double")
    return str(at)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_equals_sql(spark, star, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{star}/{t}.parquet/*.parquet'")
    df = core.queries()[name](spark, star)
    want = con.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r[i] for i in at) for r in want.fetchall()}


def test_entry_module():
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
