"""Queries against their SQL on the smallest tables, and the entry module without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rollmill.plans import catalogue, checks, mechanisms  # noqa: F401  the others add queries to the catalogue

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings benchmark labels conversations nation region".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = {c: i for i, c in enumerate(want.columns)}
    left = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(r[place[c]] for c in order) for r in want.fetchall()), key=repr)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a == b or all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_the_rest_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_barrier_takes_all_rollouts(spark, duck):
    got = sorted(map(tuple, catalogue.QUERIES["stream_group_barrier"](spark, SF).collect()))
    want = duck.sql(
        "SELECT task || ':' || run, count(*) FILTER (WHERE NOT failed), count(*) FILTER (WHERE failed), sum(CASE WHEN failed THEN 0 ELSE reward END) FROM (SELECT o_custkey AS task, "
        "(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS run, o_orderpriority = '4-NOT SPECIFIED' AS failed, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END::DOUBLE AS reward FROM orders) GROUP BY task, run"
    )
    assert got == sorted(map(tuple, want.fetchall()))
    assert sum(r[1] + r[2] for r in got) == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]


def test_token_arrays_of_all_rollouts(spark, duck):
    got = sorted(r.trajectory_id for r in catalogue.QUERIES["credit_token_arrays"](spark, SF).collect())
    want = duck.sql("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '4-NOT SPECIFIED'").fetchall()
    assert got == sorted(r[0] for r in want)


def test_entry_works_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for item in ("__spark_entry__.py", "rollmill"):
        (tmp_path / item).symlink_to(root / item) if item.endswith(".py") else None
    (tmp_path / "rollmill").mkdir()
    for item in (root / "rollmill").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (tmp_path / "rollmill" / item.name).symlink_to(item)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, len(e.oracle_sql()) > 0)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert out.stdout.split() == [str(len(catalogue.queries())), "False", "False", "True"], out.stderr
