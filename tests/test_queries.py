"""Every registered graph query against its SQL, and the entry module with and without the optional parts."""

import math
import os
import subprocess
import sys

import pytest

from pathloom.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_list_operations_read_whole_vectors(spark):
    sizes = {r["vec_id"]: len(r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    assert max(sizes.values()) > 9
    assert {r["id"]: r["n"] for r in QUERIES["list_operations"](spark, DIR).collect()} == sizes


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module imports, and lists the graph queries, where the optional parts are gone."""
    for name in ("__spark_entry__.py", "pathloom"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "pathloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    listed = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert listed == sorted(QUERIES)
