"""A sample of registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import rows_of
from veilspark.plans.kit import TABLES

SF = "/root/testdata/sf0.001"
KEYS = (
    "scan_summary", "det_provider_rules", "det_secret_generic_api_key", "det_pii_ja_address", "sup_order", "mask_match", "mask_residual",
    "psd_table", "srt_greedy_spans", "agg_audit_summary", "grd_first_category", "aud_unpinned_package", "str_dedup",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[key](spark, SF)
    want = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_rows_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    """Many splits of one row group: all of its rows are in one of them."""
    from veilspark.plans.kit import derived

    spark.range(4000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = derived(spark, str(tmp_path), "SELECT p_partkey FROM {part}")
        sizes = [len(p) for p in rows.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 4000 and max(sizes) < 1000
