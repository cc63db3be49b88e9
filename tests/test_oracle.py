"""Every registered query against its SQL, over the whole tables."""

import os

import pytest
from compare import difference, open_tables
from conftest import DATA

import __spark_entry__ as contract
from eventloom.catalog.oracle import ORACLE
from eventloom.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def small():
    return open_tables(f"{DATA}/sf0.001")


@pytest.fixture(scope="module")
def medium():
    return open_tables(f"{DATA}/sf0.01")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_batch(spark, medium, name):
    assert difference(QUERIES[name](spark, f"{DATA}/sf0.01"), medium, ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("stream_")])
def test_stream(spark, small, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert difference(QUERIES[name](spark, f"{DATA}/sf0.001"), small, ORACLE[name]) is None
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))
