"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siftline.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}'")
    return connection


def normal(rows):
    shown = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(tuple(map(str, map(shown, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    order = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*order).collect()]
    assert name in ORACLE_SQL
    columns = ", ".join(f'"{c}"' for c in order)
    assert normal(rows) == normal(duck.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())


def test_package_stands_without_the_training_part():
    """Nothing outside siftline.llm imports it."""
    root = os.path.join(os.path.dirname(__file__), "..", "siftline")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "llm" not in open(path, encoding="utf-8").read(), path


def test_vocab_joined_by_keys_of_any_size(spark, duck, tmp_path):
    """Keys beyond 20000, missing keys and names, names that do not go with their keys."""
    rows = [(k, f"Customer#{k:09d}") for k in (0, 1, 19_998, 20_000, 20_001, 900_000_000_000)] + [(4, "Customer#000000001"), (5, "Customer#000000002"), (6, None), (7, None), (None, "x"), (4, "twice")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = [tuple(r) for r in QUERIES["vocab_joined"](spark, str(tmp_path)).collect()]
    sql = f"WITH customer AS (SELECT * FROM '{tmp_path}/customer.parquet/*.parquet') {ORACLE_SQL['vocab_joined']}"
    assert normal(found) == normal(duck.execute(sql).fetchall())


def test_a_table_as_vocabulary_of_numbers(spark):
    from siftline.functions import vocab
    from siftline.plans.cleaners import RadioInput
    from siftline.plans.dsl import Model

    words = {"low": [str(k) for k in range(400)]}
    frame = spark.createDataFrame([(3, "3"), (400, "x"), (None, None)], "k long, s string")
    for given in (words, vocab.as_table(spark, words)):
        found = Model([("a__", RadioInput("$k", given, "flag")), ("b__", RadioInput("$s", given, "flag"))])(frame)
        assert sorted(map(str, ((r["a"], r["b"]) for r in found.collect()))) == ["('!400', '!x')", "('low', 'low')", "(None, None)"]
