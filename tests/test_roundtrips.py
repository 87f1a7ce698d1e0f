"""Files of brands with more parts than an upload may have rows, written and read back, against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["csv_roundtrip", "xlsx_roundtrip"])
def test_whole_brands_come_back(spark, tmp_path, name):
    part = f"'{tmp_path}/part.parquet'"
    duckdb.sql(
        "COPY (SELECT k * 3 - 30001 AS p_partkey, 'part ' || k AS p_name, CASE WHEN k % 40 > 1 THEN 'Brand/1' WHEN k % 40 = 1 THEN 'Brand#2' END AS p_brand, "
        f"(90000 + k * 7) / 100 AS p_retailprice FROM range(10000, 31700) t(k) ORDER BY hash(k)) TO {part}"
    )
    want = duckdb.sql(entry.oracle_sql()[name].replace("FROM part", f"FROM {part}")).fetchall()
    got = entry.queries()[name](spark, str(tmp_path)).select("doc_id", "row_ord", "code", "name", "price").collect()
    assert len(got) == len(want) == 21700
    assert max(r["row_ord"] for r in got) > 20000
    assert set(map(tuple, got)) == set(want)
