"""The named queries against their SQL, on the smallest shared tables."""

import glob
import os

import duckdb
import pytest

from eventloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    reply = duck.execute(catalogue.oracle_sql()[name])
    order = sorted(range(len(reply.description)), key=lambda i: reply.description[i][0])
    assert [reply.description[i][0] for i in order] == columns
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in reply.fetchall())


def test_folder_features_follow_the_keys_not_the_file(spark, tmp_path):
    """Rows out of the order of their keys, and times within one millisecond."""
    rows = []
    for part in range(4):
        for case, moments in ((part, (2, 1)), (part + 4, (1, 2))):
            told = [(10 * case + i, case, "FO"[i], f"2024-01-01 00:00:00.00000{m}") for i, m in enumerate(moments)]
            rows += told if case < 4 else told[::-1]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, t string")
    df.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "t::timestamp as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.queries()["folder_features"](spark, str(tmp_path)).select("part", "unique_case_count", "variant_count", "dfg_density")
    expected = duckdb.connect()
    expected.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    told = expected.execute(f"select part, unique_case_count, variant_count, dfg_density from ({catalogue.oracle_sql()['folder_features']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(told) == [(part, 2, 1, 0.5) for part in range(4)]


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() == 1


def test_nothing_outside_imports_the_text_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/eventloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "eventloom.llm" not in open(path).read(), path
