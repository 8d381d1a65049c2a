"""Registered queries against DuckDB on the smallest tables, and the entry point with and without the optional parts."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    import numpy as np
    import pandas as pd

    if isinstance(v, list | tuple | np.ndarray):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool | np.bool_ | int | np.integer):
        return int(v)
    return round(float(v), 9) if isinstance(v, float | np.floating) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


def names():
    from corpusloom import registry

    return sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from corpusloom import registry

    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """A copy of the repository without them imports, and registers the rest."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spell_check' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
