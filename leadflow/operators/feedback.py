"""Feedback review log and approved-rule store as tables.

Decisions are events; an item's status is its newest decision (pending if none).
Approving twice no longer appends a rule twice: promotion anti-joins the rule table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import newest_per, pick_newest

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"


def last_decisions(decisions: DataFrame) -> DataFrame:
    """(id, decision, decided_at): the newest decision per item (ties: higher event id)."""
    per = newest_per(decisions, ["id", "decision"], [])
    return pick_newest(per, ["id"], ["decision"]).withColumnRenamed("ts", "decided_at")


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status, decided_at) for every item."""
    return (items.select("id").join(last_decisions(decisions), "id", "left")
            .select("id", F.coalesce(F.col("decision"), F.lit(PENDING)).alias("status"), "decided_at"))


def approved_rules(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, sql_text, approved_at): approved items that carry SQL."""
    last = last_decisions(decisions).where(F.col("decision") == F.lit(APPROVED))
    return (items.where(F.col("sql_text").isNotNull()).join(last, "id")
            .select("id", "sql_text", F.col("decided_at").alias("approved_at")))


def unpromoted(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates not yet in the rule table (left anti join on id)."""
    return candidates.join(rules.select("id"), "id", "left_anti")


def promote(rules: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rule table after promotion: existing rules plus new approved ones, each once."""
    new = unpromoted(approved_rules(items, decisions), rules)
    return rules.select("id", "sql_text", "approved_at").unionByName(new)


def status_counts(items: DataFrame, decisions: DataFrame) -> DataFrame:
    return apply_decisions(items, decisions).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def merge_corrections(corrections: DataFrame) -> DataFrame:
    """Fold a session's corrections into one query record.

    Newest non-NULL metric and time window win (by ``seq``); filter values accumulate
    (distinct, sorted, joined with ',' - NULL when there are none).  Values are made distinct
    per session before they are gathered, so a row holds no more than a session's distinct
    filter values."""
    kinds = ["metric", "time_key", "filter_value"]
    per = (corrections.unpivot(["session_id", "seq"], kinds, "kind", "value")
           .groupBy("session_id", "kind", "value").agg(F.max("seq").alias("seq")))

    def of(kind: str, col: str):
        return F.when((F.col("kind") == F.lit(kind)) & F.col("value").isNotNull(), F.col(col))

    vals = F.array_sort(F.collect_set(of("filter_value", "value")))
    return (per.groupBy("session_id")
            .agg(F.max_by("value", of("metric", "seq")).alias("metric"),
                 F.max_by("value", of("time_key", "seq")).alias("time_key"), vals.alias("_vals"))
            .select("session_id", "metric", "time_key",
                    F.when(F.size("_vals") > 0, F.array_join("_vals", ",")).alias("filter_values")))
