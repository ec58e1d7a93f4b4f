"""Rows of one row group become many tasks' work where each row is a lot of it."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.plans import all_oracles, all_queries

ROWS = 64
CUSTOMER = f"SELECT range AS c_custkey, 'Customer#' || range AS c_name, 1 + range % 5 AS c_nationkey, 10.5 AS c_acctbal, 'AUTO' AS c_mktsegment FROM range({ROWS})"
ORDERS = f"SELECT range AS o_orderkey, range * 7 AS o_custkey, 'O' AS o_orderstatus, 99.25 AS o_totalprice, TIMESTAMP '1995-01-02' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range({ROWS})"


@pytest.mark.parametrize("name", ["redact_full_cascade", "contextual_rules", "all_rules", "redact_cells_customer"])
def test_one_row_group_is_many_tasks(spark, tmp_path, name):
    duckdb.sql(f"COPY ({CUSTOMER}) TO '{tmp_path}/customer.parquet'")
    duckdb.sql(f"COPY ({ORDERS}) TO '{tmp_path}/orders.parquet'")
    done = all_queries()[name](spark, str(tmp_path))
    shares = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == ROWS and max(shares) <= ROWS // 4
    if name == "redact_full_cascade":
        duckdb.sql(f"CREATE OR REPLACE VIEW customer AS {CUSTOMER}")
        want = duckdb.sql(all_oracles()[name]).fetchall()
        assert sorted(map(tuple, done.collect())) == sorted(want)
