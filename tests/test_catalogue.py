"""Every core query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import votemill
from compare import rows
from votemill.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.sql(catalogue.SQL[name])
    assert got == rows(r.columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_core_does_not_import_the_llm_subpackage():
    core = [f for f in Path(votemill.__file__).parent.rglob("*.py") if "llm" not in f.parts]
    assert len(core) > 15 and not [f for f in core if "votemill.llm" in f.read_text()]
