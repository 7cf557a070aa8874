"""Plan shapes that matter at scale."""

import contextlib
import io as _io
import re

import pytest

import __spark_entry__ as E
from leadflow.operators.query import metric_query
from leadflow.sources import fixtures as fx


def plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_unpivot_reads_once(spark, sf):
    p = plan(E.queries()["u_names_8"](spark, sf))
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, flags=re.M)) == 1 and "Expand" in p


def test_per_product_top_n_uses_group_limit(spark, sf):
    assert "WindowGroupLimit" in plan(E.queries()["t_recent_ids_per_product"](spark, sf))


def test_product_dim_is_broadcast_after_aggregation(spark, sf):
    p = plan(E.queries()["j_product_dim"](spark, sf))
    assert "BroadcastHashJoin" in p
    assert p.index("HashAggregate") > p.index("BroadcastHashJoin")   # aggregate sits below the join


def test_window_filter_pushed_to_scan(spark, sf):
    p = plan(E.queries()["g_metric_query"](spark, sf))
    assert "PushedFilters: [IsNotNull(bookingdate), GreaterThanOrEqual(bookingdate,2000-06-01)" in p


def test_projection_pruned(spark, sf):
    p = plan(E.queries()["m_premium"](spark, sf))
    read = [line for line in p.splitlines() if line.strip().startswith("ReadSchema")]
    assert read and all("premium" in r and "customerid" not in r for r in read)


def test_similarity_join_is_equi_join(spark, sf):
    p = plan(E.queries()["j_fuzzy_names"](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


FACT_SIZED = ("j_names_to_codes", "a_candidates", "a_status_summary", "a_status_breakdown", "a_status_details",
              "j_agent_status", "r_apply_decisions", "r_promote_approved", "r_status_counts", "j_unpromoted_rules",
              "r_merge_corrections", "t_most_common_name")


@pytest.mark.parametrize("key", FACT_SIZED)
def test_no_sort_over_the_whole_input(spark, sf, key):
    """The first aggregation over a scan hashes: no Sort or SortAggregate stands below the first
    exchange above any scan."""
    def walk(node, below):
        name = node.nodeName()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if name.startswith("AdaptiveSparkPlan"):
            kids = [node.initialPlan()]
        unexchanged = [k for c in kids for k in walk(c, below)] if kids else [name]
        if "Exchange" in name:
            return []
        assert not (unexchanged and name in ("Sort", "SortAggregate")), f"{name} over {unexchanged}"
        return unexchanged
    walk(E.queries()[key](spark, sf)._jdf.queryExecution().executedPlan(), [])


def test_similarity_join_has_no_pairwise_group_expansion(spark, sf):
    p = plan(E.queries()["a_candidates"](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in p


@pytest.mark.parametrize("key", ["g_product_wise", "g_metric_query", "g_by_two_dims", "t_top_n", "f_since_prev_month", "u_distinct_ids",
                                 "u_distinct_ids_per_product", "a_active_ids"])
def test_spans_of_booking_dates_read_their_months_only(spark, sf, key):
    """The copy by booking month is scanned, and its partitions are filtered."""
    out = E.queries()[key](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and "bookingdate" in line]
    assert len(scan) == 1 and "booking_month" in scan[0].split("PartitionFilters: ")[1].split("]")[0]
    assert "bookingdate" in scan[0].split("PushedFilters: ")[1].split("]")[0]


def test_jobs_without_such_a_span_read_all_rows(spark, sf):
    facts = fx.facts(spark, sf)
    for out in (metric_query(facts, ["bookings"], dims=["state"]), metric_query(facts, ["leads"], dims=["state"], window="this_month", as_of=fx.AS_OF)):
        assert "booking_month" not in out._jdf.queryExecution().executedPlan().toString()
    assert metric_query(facts, ["leads", "bookings"]).first()[0] == facts.full.count() > facts.booked(None, None).count()
