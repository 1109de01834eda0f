"""Every registered query of the core gives the rows of its SQL at the smallest size."""

import duckdb
import pytest

from sluice.plans.catalogue import ORACLES, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted((tuple(str(x) if not isinstance(x, float) else f"{x:.6g}" for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want)
