"""Texts that sf0.1 has none of: none at all, empty ones, blanks, and replacement characters of their own."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluice.functions.doors import door
from sluice.plans.catalogue import ORACLES, QUERIES
from sluice.types import Door

TEXTS = ["plain", None, "", " ", "\t\n", "\ufffd", "é\ufffd x", "\ufffc\ufffd", "😀 e\u0301", 'q"uo""te', "a\r\nb\rc\n", "\x00", "\ufeffmark", "x" * 70_000]


@pytest.mark.parametrize("name", ["door_text_utf8", "frame_ranges"])
def test_same_rows_as_sql(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("cell, at", [(b"\xff", 0), (b"a\xff", 1), (b"\xef\xbf\xbd\xff", 3), (b"\xef\xbf\xbda\xef\xbf\xbd\xe2\xef\xbf\xbd", 7), (b"\xef\xbf", 0), (b"\xef\xbf\xef\xbf\xbd", 0), (b"\xef\xbf\xbc\xff\xef\xbf\xbd", 3)])
def test_place_of_the_first_fault(spark, cell, at):
    got = spark.createDataFrame([(bytearray(cell),)], "raw binary").select(door(Door.TEXT, F.col("raw")).alias("c")).first()["c"]
    assert (got["reason"], got["detail"], got["offset"]) == ("malformed", "invalidUtf8", at)
