from __future__ import annotations

import glob
import os
from collections import Counter

import pandas as pd
import pytest

from tariffmill.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df) -> Counter:
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return str(v) if isinstance(v, bool | str) else repr(round(float(v), 6))

    return Counter(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_matches_sql(spark, data, duck, name):
    got, want = catalog.queries()[name](spark, data).toPandas(), duck.sql(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.flagship(spark, data).count() > 0


def test_columns_of_found(spark, data):
    want = {
        "p2_found": "table_name string, row_id bigint, pos int, val string", "p4_found": "file_id bigint, change string, old_header string, new_header string",
        "p5_found": "table_name string, row_id bigint, reason string",
    }
    for name, columns in want.items():
        assert ", ".join(" ".join(t) for t in catalog.queries()[name](spark, data).dtypes) == columns
