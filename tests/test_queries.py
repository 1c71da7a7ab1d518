"""Every registered query with SQL gives what DuckDB gives; results are not empty."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallymark import catalogue

#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"redact_documents", "email_findings", "emails_masked", "rule_matrix", "content_digest_dups", "fleet_warnings"}


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{v:.9g}" if isinstance(v, float) and v != int(v) else str(int(v) if isinstance(v, float) else v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    assert name in catalogue.ORACLES
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) >= 80"], cwd=root, check=True)
