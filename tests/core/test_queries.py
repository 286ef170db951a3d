"""Every core query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from haplospark.entry import FLAGSHIP, ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
#: Queries of haplotypes that the smallest tables have too few reads for.
LARGER = {name: "/root/testdata/sf0.01" for name in ("compare_haps", "hap_match", "unique_support", "nonunique_reads", "low_support_filter", "hap_naming", "two_copy_test", "highest_copy_number", "rescued_links")}


@pytest.fixture(scope="module")
def tables():
    connections = {}
    for data in (DATA, *set(LARGER.values())):
        connections[data] = duckdb.connect()
        for file in os.listdir(data):
            connections[data].execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return connections


def plain(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    data = LARGER.get(name, DATA)
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    assert rows or name not in LARGER
    if name in ORACLE_SQL:
        cursor = tables[data].execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in cursor.fetchall())


def test_entry(spark):
    assert FLAGSHIP in entry.queries() and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
