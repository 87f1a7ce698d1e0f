"""Costs whose ties lie beside them in binary, and amounts of more than two places, against the query's SQL."""

import duckdb

import __spark_entry__ as entry


def test_costs_match_sql(spark, tmp_path):
    duckdb.sql(
        "COPY (SELECT row_number() OVER () AS s_suppkey, a AS s_acctbal FROM (SELECT (k * 50)::double AS a FROM range(-3, 400) t(k) "
        f"UNION ALL SELECT unnest([0.004, 0.005, 1.005, 249.996, 9999.994, 9999.996, 20000, 1005000, 123456789.01, NULL]))) TO '{tmp_path}/supplier.parquet'"
    )
    want = dict(duckdb.sql(entry.oracle_sql()["print_costs"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet'")).fetchall())
    got = {r["s_suppkey"]: r["cost"] for r in entry.queries()["print_costs"](spark, str(tmp_path)).collect()}
    assert len(got) == 413 and got == want
    assert "$0.0001" in {got[k] for k in range(1, 10)}
