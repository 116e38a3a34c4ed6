"""Plans: what reaches the scan, where rows gather, what is broadcast."""

import re

import pytest

from statspine.operators import ranking as R
from statspine.plans import load
from statspine.plans import standin as S
from tests.conftest import SF_DIR

QUERIES = load().QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# what may meet in one task: partial aggregates without keys, slices cut in every task first, totals of ranges
MEETS = re.compile(r"keys?=\[\], functions=\[(partial_|merge_)|LocalLimit|keys=\[_bucket#|Window \[.*_bucket|LocalTableScan|Scan ExistingRDD|Range ")


def gathered(text):
    """What stands below each exchange that sends all rows to one task."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


SLOW_TO_BUILD = re.compile(r"^(I|K|T\d_\w+_stream|T2_hourly|N2)")


@pytest.mark.parametrize("name", [n for n in QUERIES if not SLOW_TO_BUILD.match(n)])
def test_no_python_rows_and_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    assert [x for x in gathered(text) if not MEETS.search(x)] == []


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["P2_comparisons"](spark, SF_DIR))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "EqualTo(l_linestatus,F)" in text
    schema = text[text.index("ReadSchema") :].splitlines()[0]
    assert "l_comment" not in schema and "l_shipdate" not in schema and "l_tax" not in schema


def test_keyset_page_bound_reaches_the_scan(spark):
    text = plan(QUERIES["L5_page_after_key"](spark, SF_DIR))
    assert "GreaterThan(o_orderkey,1000)" in text and "TakeOrderedAndProject" in text


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["L3_top_k"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan(QUERIES["L4_top_k_per_group"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan(QUERIES["D15_kpi_metrics"](spark, SF_DIR))


def test_trends_move_counts_only(spark):
    """What is exchanged are partial aggregates: the written observations stay where they are."""
    df = QUERIES["D7_category_trends"](spark, SF_DIR)
    lines = plan(df).splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert moved and all(re.search("HashAggregate|Window|Project", line) for line in moved)
    assert not any("obs_value" in line and "Exchange" in line for line in lines)


def test_numbering_windows_are_partitioned(spark):
    lines = S.table(spark, SF_DIR, "lineitem").select("l_orderkey", "l_quantity")
    text = plan(R.global_row_number(lines, ["l_quantity"]))
    # the only rows that meet in one task are the totals, one per range
    (below,) = gathered(text)
    assert "keys=[_bucket#" in below and "sum(_n" in below
