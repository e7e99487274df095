"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from factloom import queries as core  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings facts chunks extract_cache index_vectors source_list fact_groups unit_catalog given_names doc_labels".split()


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    r = c.execute(core.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    want = sorted([str(v) for _, v in sorted(zip(columns, row))] for row in r.fetchall())
    df = core.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    got = sorted([str(row[k]) for k in sorted(columns)] for row in df.collect())
    assert got == want


def test_entry(spark, small):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
