"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from check import rows_of
from registry.oracles import ORACLES
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    session = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        session.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return session


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SMALL)
    got = rows_of(frame.columns, frame.collect())
    assert got, "a registered query gives rows"
    if name in oracle_sql():
        answer = duck.execute(oracle_sql()[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == sorted(frame.columns)
        assert got == rows_of(columns, answer.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 50


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"decode_body"}
