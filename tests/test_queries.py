"""A sample of the registered queries against the oracle; ``tools/check_oracle.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from sourceassay.plans import oracle
from sourceassay.plans.queries import QUERIES
from tests.conftest import SMALL
from tools.check_oracle import TABLES, canonical

SAMPLE = ("flt_1_prune_dirs", "str_1_strip_comments", "prj_9_hash_and_sizes", "ext_7_arithmetic_ops", "ext_13_nested_record",
          "joi_2_reentrancy", "joi_11_splice", "agg_1_scan_summary", "agg_11_audit_outcomes", "win_2_finding_numbers",
          "rul_all", "val_b7_ids", "sig_5_unchecked_external_call", "sig_16_web3_broken_access_control", "snk_1_report_json")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, db, name):
    got = canonical(entry.queries()[name](spark, SMALL).toPandas())
    want = canonical(db.execute(entry.oracle_sql()[name]).df())
    assert len(got) and got.equals(want)


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(QUERIES)


@pytest.mark.parametrize("name", ("rul_all", "joi_2_reentrancy", "sig_2_broken_auth", "joi_4_unknown_files", "ext_13_nested_record"))
def test_plans(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_map_only_plans(spark):
    for name in ("ext_1_line_calls", "ext_8_functions", "sig_0_fn_nodes"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_language_filter_prunes_partitions(spark):
    plan = entry.queries()["str_6_pragma_version"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and ".sol" in plan.split("PartitionFilters")[1][:200]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
