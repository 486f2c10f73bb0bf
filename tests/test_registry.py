"""Every query against its SQL on the smallest tables, and what the registry promises."""

import glob
import importlib
import math
import os
import subprocess
import sys

import duckdb
import pytest

from tapeloom import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, small, db, name):
    got = plans.queries()[name](spark, small)
    rel = db.sql(plans.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_the_others_run(spark, small, name):
    assert plans.queries()[name](spark, small).collect() is not None


def test_names_and_coverage():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert len(plans.covered()) > 240


def test_core_does_without_llm():
    code = "import sys; sys.modules['tapeloom.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p2_') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode == 0
    for name in plans.MODULES:
        assert "tapeloom.llm" not in open(importlib.import_module(f"tapeloom.plans.{name}").__file__).read()
