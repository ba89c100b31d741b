"""Every query of the catalogue against its DuckDB oracle, on the smallest driver tables."""

import os

import duckdb
import pytest

from quirespark.plans import catalogue, note_queries  # noqa: F401 (registers its queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows
    if name in catalogue.ORACLES:
        duck.register("got", got)
        columns = ", ".join(f'"{c}"' for c in got.column_names)
        for a, b in (("got", f"({catalogue.ORACLES[name]})"), (f"({catalogue.ORACLES[name]})", "got")):
            assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
        duck.unregister("got")


def test_entry_without_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
