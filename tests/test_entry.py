import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_each_feature_query_has_sql():
    from chronoloom import queries as own

    assert set(own.queries()) == set(own.oracle_sql())


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without them imports and offers the other queries."""
    for f in ROOT.rglob("*.py"):
        rel = f.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_bytes(f.read_bytes())
    code = "import __spark_entry__ as e; assert 'static_mean' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name in ("static_kurtosis", "static_spectral_centroid", "expanding_change", "sliding_trend", "static_short_series"):
        got = entry.queries()[name](spark, DATA)
        want = con.execute(entry.oracle_sql()[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
