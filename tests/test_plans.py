"""Plan shape: the operators stay in the JVM, push filters and columns to
the scan, and never put the scored rows in one partition."""
import pytest
from sf_paths import SF_SMALL

import __spark_entry__ as entry
from parcelrisk.plans.registry import ORACLE, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + \
        df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sql_checked_plans(spark):
    """Executed-plan text of every SQL-checked query, planned once."""
    return {name: QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            for name in ORACLE}


def test_no_python_udf_in_sql_checked_queries(sql_checked_plans):
    # only the zip readers run Python on executors (one archive or member per task)
    for name, p in sql_checked_plans.items():
        if name in ("zip_scan", "zip_latin1", "extract_tables"):
            assert "MapInPandas" in p
            continue
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow",
                     "FlatMapGroupsInPandas"):
            assert node not in p, (name, node)


def test_filter_and_columns_reach_the_scan(spark):
    df = entry.queries()["sql_filter_and"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_orderstatus), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in p
    assert "o_orderpriority" not in p          # the unused column is pruned from the scan


def test_roc_has_no_single_partition_over_rows(spark):
    df = entry.queries()["roc_curve"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the only SinglePartition exchange is above the per-range totals
    for chunk in p.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[_pr_range" in chunk.split("Exchange hashpartitioning")[0] + \
            chunk.split("\n")[1] or "_pr_range" in chunk.split("\n")[1]


def test_membership_key_side_is_deduplicated_before_the_join(spark):
    df = entry.queries()["label_membership"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in p and "HashAggregate(keys=[_pr_k0" in p


def test_level_index_has_no_single_partition_over_levels(spark):
    df = entry.queries()["one_hot_levels_wide"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the levels are numbered by a range-partitioned sort; the only
    # SinglePartition exchange carries one row per sorted partition
    for chunk in p.split("Exchange SinglePartition")[1:]:
        assert "_pr_pid" in chunk.split("\n")[0] or "_pr_pid" in chunk.split("\n")[1]


def test_single_partition_exchanges_only_carry_bounded_tables(sql_checked_plans):
    """Across every SQL-checked query, an ``Exchange SinglePartition`` sits
    directly on a global partial aggregate (one row per task), on range
    totals (one row per range), on per-partition counts of a sort, or on a limit
    that the caller gave (the first rows of a file)."""
    import re
    bounded = re.compile(r"((Object)?HashAggregate\(keys|SortAggregate\(key)=\[(\]|_pr_range|_pr_pid)|LocalLimit 100$")
    for name, p in sql_checked_plans.items():
        for chunk in p.split("Exchange SinglePartition")[1:]:
            child = chunk.split("\n")[1]
            assert bounded.search(child), (name, child.strip()[:120])


def test_running_sums_mark_no_side_for_broadcast(spark):
    """What grows with the rows is joined by measured size, never by a hint."""
    for name in ("roc_curve", "describe_by_class", "box_stats", "row_at_far", "one_hot_levels_wide"):
        df = QUERIES[name](spark, SF_SMALL)
        assert "strategy=broadcast" not in df._jdf.queryExecution().logical().toString()
