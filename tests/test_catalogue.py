import math
import os

import pytest

import __spark_entry__
from loomdex import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 9) if isinstance(v, float) else v.isoformat()[:26] if hasattr(v, "isoformat") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(v) for v in r) for r in df.where(df.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_point_works_without_the_optional_subpackage():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    said = "import sys; sys.modules['loomdex.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; from jobs import catalogue as j; assert set(e.queries()) == set(__import__('loomdex.catalogue', fromlist=['x']).QUERIES) | set(j.QUERIES)"
    assert subprocess.run([sys.executable, "-c", said], cwd=root, check=False).returncode == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "loomdex"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "loomdex.llm" in p.read_text("utf-8")]


def test_filters_and_columns_reach_the_scan(spark):
    plan = lambda name: catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    text = plan("symbol_file_join")
    assert "GreaterThan(l_quantity,45.0)" in text and "l_shipdate" not in text
    assert "EqualTo" in plan("point_lookup") or "Or(" in plan("point_lookup")
    assert not any("Python" in plan(n) or "CartesianProduct" in plan(n) for n in ("call_resolve", "snapshot_diff", "rename_pairs", "token_overlap", "unresolved_refs", "evict_prefix", "greedy_prune", "bm25_rank"))
