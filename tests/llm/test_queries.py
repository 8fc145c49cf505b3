import glob
import os

import duckdb
import pytest

import __spark_entry__
from tamarack.llm import queries


AT = os.environ.get("TAMARACK_TEST_TABLES", "/root/testdata/sf0.001")


def test_each_operator_has_one_query():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    if not os.path.isdir(AT):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{AT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, AT)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert got and got == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
