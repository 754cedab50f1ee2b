"""Every query with SQL gives the same rows as DuckDB; none needs the training-data subpackage."""

import os

import duckdb
import numpy as np
import pytest

from leadlens.catalog import oracle_sql, queries


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.bool_):
        return bool(v)
    return str(v)[:19] if hasattr(v, "isoformat") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = rows(queries()[name](spark, sf_dir).toPandas()), rows(duck.sql(oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    plan = queries()["union_all"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,300000" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/leadlens", tmp_path / "leadlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [x for x in q if x.startswith('op') and x[2].isdigit()]; assert 'overview_kpis' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
