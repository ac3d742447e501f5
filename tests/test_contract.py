"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as contract
from corpusloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations sales sale_lines items vendors clients".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    cursor = duck.execute(plans.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_no_other_module_needs_the_llm_operators():
    from pathlib import Path

    import corpusloom

    top = Path(corpusloom.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "llm import" not in path.read_text(), path
