"""Every query against its SQL, on the smallest tables."""

import pytest
from oracle import difference, views

from lakewright.plans import all_queries

QUERIES, SQL = all_queries()
#: May be empty on the smallest tables.
SPARSE = {"having_single", "except_keys", "er_sole_holder", "er_unique_rule", "drop_siblings"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    said = difference(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert said == "" or (said == "no rows" and name in SPARSE)


def test_rotation_is_a_hash_of_the_name(spark, sf_dir):
    def fnv(text):
        h = 0x811C9DC5
        for b in text.encode():
            h = (h ^ b) * 0x01000193 % 2**32
        return h

    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").collect()]
    first = 19723  # days from 1970 to 2024
    want = {}
    for n in names:
        want[fnv(n) % 30] = want.get(fnv(n) % 30, 0) + 1
    got = {r["day"]: r["n"] for r in QUERIES["fnv_rotation"](spark, sf_dir).collect()}
    assert got == {f"2024-01-{d + 1:02d}": want[(first + d) % 30] for d in range(30) if (first + d) % 30 in want}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "o_orderkey" in df.columns
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
