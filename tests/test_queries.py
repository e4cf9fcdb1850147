"""Every registered query against its SQL, and the plans of the main ones."""

import re

import pytest
from compare import duck, spark_rows, sql_rows

import __spark_entry__ as contract
from tidewire.catalog.queries import QUERIES

ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, connection, name):
    got = spark_rows(QUERIES[name](spark, folder))
    assert got == sql_rows(connection, ORACLE[name])


def test_entry(spark):
    assert contract.entry(spark).count() == 308


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"scan_feed_xml", "scan_multi_link"} - {n for n in QUERIES if n.startswith("stream_")}))
def test_no_pairwise_joins(spark, folder, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, folder)))


def test_columns_are_pruned(spark, folder):
    text = plan(QUERIES["item_matches"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("text" in s and "n_chars" not in s for s in schemas)
    assert all("props" not in s and "user_id" not in s for s in schemas)


@pytest.mark.parametrize("name", ["item_matches", "sql_route"])
def test_matching_stays_in_the_jvm_and_tokenises_once(spark, folder, name):
    text = plan(QUERIES[name](spark, folder)).split("== Physical Plan ==")[1]
    assert "Python" not in text and "Arrow" not in text
    assert text.count("(?=[") == 1
