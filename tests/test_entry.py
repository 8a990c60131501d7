"""Every registered query against its SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadtide.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["tick", "place", "value1", "value2"]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_every_inventory_item_has_a_query():
    counts = {"B": 10, "D": 9, "E": 11, "F": 18, "G": 4, "H": 8, "J": 15, "K": 24, "L": 4}
    wanted = [f"{c}{n}" for c, last in counts.items() for n in range(1, last + 1)]
    wanted += [f"A{n}" for n in (1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16)] + [f"C{n}" for n in (*range(1, 13), 15, 17)]
    wanted += ["D11", "D12"] + [f"I{n}" for n in (1, 2, 3, 4, 5, 6, 8)] + [f"Q{n}{v}" for n in range(1, 7) for v in "ab"] + ["Q7", "Q8"]
    have = {name.split("_")[0] for name in entry.queries()}
    assert not set(wanted) - have


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)
