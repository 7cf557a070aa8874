"""Agent resolution and live-status roll-ups.

The source system resolved agents with several queries per request and fetched
status with one HTTP call per agent in a loop; here each job is one plan:
active agents (join) latest status -> group by product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as TX
from ..functions import windows as W
from ..functions.metrics import ISSUED
from ..sources.facts import Facts, rows_in_window
from . import names as N
from .similarity import fuzzy_pairs, single_word_guard, trigram_guard, with_guard_columns
from .topk import newest_key, newest_per, pick_newest

# Statuses that count as "active now" when no status is asked for.
DEFAULT_ACTIVE_STATUSES = ("READY", "AVAILABLE", "IDLE", "ONCALL", "ON CALL", "BUSY")


def _agent_base(leads: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (leads.where(P.non_blank("lead_agentid"))
            .select("investmenttypeid", "lead_agentid", W.event_date().alias("event_date"), *cols))


def resolve_agent_id(leads: DataFrame, name: str, products: Sequence[int] | None = None,
                     cols: Sequence[str] = N.NAME_COLUMNS_8) -> DataFrame:
    """One agent id for a name (stripped): the newest id among rows of the given products whose
    names contain it, else among all rows.  One scan, one aggregation.

    (The source tries a third step, rows that equal the most common name containing the text;
    such a row contains the text itself, so the second step has already found it.)
    Returns (query_name, lead_agentid, resolved_by); no row if nothing matches or the name is
    empty."""
    name = name.strip()
    base = _agent_base(leads, cols)
    key = newest_key(F.col("event_date"), F.col("lead_agentid"))
    in_prod = P.product_in(products) if products else F.lit(False)
    found = base.where(P.contains_any(cols, name) & F.lit(bool(name))).agg(
        F.min_by("lead_agentid", F.when(in_prod, key)).alias("in_product"), F.min_by("lead_agentid", key).alias("any"))
    return (found.where(F.col("any").isNotNull())
            .select(F.lit(name).alias("query_name"), F.coalesce("in_product", "any").alias("lead_agentid"),
                    F.when(F.col("in_product").isNotNull(), "product").otherwise("any").alias("resolved_by")))


def name_pool(leads: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-blank names of the columns with their normalised form."""
    return (N.unpivot_names(leads.select(*cols), cols, ids=()).select("name").distinct()
            .select("name", TX.norm_name("name").alias("p_norm")))


def _top(df: DataFrame, k: int) -> DataFrame:
    """Best ``k`` names per distinct query string (score desc, name asc).

    ``row_number() <= k`` runs as a ``WindowGroupLimit`` on both sides of the shuffle."""
    w = Window.partitionBy("q_norm").orderBy(F.col("score").desc(), F.col("name"))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= int(k))


def _distinct_queries(q: DataFrame) -> DataFrame:
    """Each normalised query string once: ranking depends only on the string, so repeated
    strings are matched once and the matches joined back to every query id."""
    return q.select(F.col("q_norm").alias("q_id"), "q_norm").distinct()


def fuzzy_join(queries: DataFrame, pool: DataFrame, cutoff: float) -> DataFrame:
    """(q_id, q_norm, name, p_norm, score) for every query row and pool name scoring >= cutoff;
    each distinct query string is matched once."""
    matches = fuzzy_pairs(_distinct_queries(queries), pool, cutoff).drop("q_id")
    return queries.select("q_id", "q_norm").join(matches, "q_norm").select(
        "q_id", "q_norm", "name", "p_norm", "score")


def codes_by_name(leads: DataFrame, cols: Sequence[str] = N.NAME_COLUMNS_6,
                  products: Sequence[int] | None = None) -> DataFrame:
    """(lname, lead_agentid, last_dt): newest agent id per lower-cased name.

    First the last date of each distinct (name, id) pair: a date is a primitive buffer, so this
    is a hash aggregation on both sides of the shuffle and only distinct pairs travel, however
    many rows a hot name holds.  The newest id is then picked among those few pairs."""
    base = _agent_base(leads, cols)
    if products:
        base = base.where(P.product_in(products))
    long = N.unpivot_names(base, cols, ids=("lead_agentid", "event_date")).select(
        F.lower("name").alias("lname"), "lead_agentid", "event_date")
    pairs = long.groupBy("lname", "lead_agentid").agg(F.max("event_date").alias("event_date"))
    return pairs.groupBy("lname").agg(
        F.min_by("lead_agentid", newest_key(F.col("event_date"), F.col("lead_agentid"))).alias("lead_agentid"),
        F.max("event_date").alias("last_dt"))


def newest_codes(leads: DataFrame, names: DataFrame, cols: Sequence[str] = N.NAME_COLUMNS_6,
                 products: Sequence[int] | None = None) -> DataFrame:
    """(name, lead_agentid, last_dt): the newest agent id of rows naming each ``name``
    (lower-cased equality against any of ``cols``); names never seen drop out."""
    wanted = names.select("name", F.lower("name").alias("lname"))
    return wanted.join(codes_by_name(leads, cols, products), "lname").select("name", "lead_agentid", "last_dt")


def candidates(leads: DataFrame, queries: DataFrame, products: Sequence[int] | None = None,
               k: int = 5, cutoff: float = 88.0) -> DataFrame:
    """Names scoring >= 88 against each query (best 5, over the six agent columns), each with
    its newest agent id; names without an id drop out.  ``queries``: (q_id, q_name)."""
    q = queries.select("q_id", "q_name", TX.norm_name("q_name").alias("q_norm"))
    pool = name_pool(leads, N.NAME_COLUMNS_6)
    pairs = (with_guard_columns(fuzzy_pairs(_distinct_queries(q), pool, cutoff))
             .where(single_word_guard() & trigram_guard())
             .select("q_id", "q_norm", "name", "p_norm", "score"))
    top = _top(pairs, k).drop("q_id").withColumn("lname", F.lower("name"))
    best = top.join(codes_by_name(leads, N.NAME_COLUMNS_6, products), "lname")
    return (q.join(best, "q_norm")
            .select("q_id", "q_name", "name", "score", "rank", "lead_agentid"))


def suggest(leads: DataFrame, queries: DataFrame, k: int = 5, cutoff: float = 85.0) -> DataFrame:
    """Names scoring >= 85 against each query over the eight name columns, best 5.

    The query is only lower-cased and trimmed (not blank-collapsed), as in the source."""
    q = queries.select("q_id", "q_name", F.trim(F.lower("q_name")).alias("q_norm"))
    pool = name_pool(leads, N.NAME_COLUMNS_8)
    pairs = (with_guard_columns(fuzzy_pairs(_distinct_queries(q), pool, cutoff)).where(trigram_guard())
             .select("q_id", "q_norm", "name", "p_norm", "score"))
    return (q.join(_top(pairs, k).drop("q_id"), "q_norm")
            .select("q_id", "q_name", "name", "score", "rank"))


def active_rows(leads: DataFrame | Facts, as_of) -> DataFrame:
    """Rows of agents with an issued booking since the first of the previous month."""
    return rows_in_window(leads, "bookingdate", "since_prev_month", as_of=as_of).where(P.non_blank("lead_agentid") & (F.col("booking_status") == F.lit(ISSUED))
                       & W.in_window("bookingdate", "since_prev_month", as_of))


def active_ids(leads: DataFrame | Facts, as_of) -> DataFrame:
    """(lead_agentid, bookings, last_booking) for every active agent."""
    return (active_rows(leads, as_of).groupBy("lead_agentid")
            .agg(F.count(F.lit(1)).alias("bookings"), F.max("bookingdate").alias("last_booking")))


def active_pairs(leads: DataFrame | Facts, as_of, products: Sequence[int] | None = None) -> DataFrame:
    """Distinct (product, agent id) of active agents."""
    rows = active_rows(leads, as_of)
    if products:
        rows = rows.where(P.product_in(products))
    return rows.select("investmenttypeid", "lead_agentid").distinct()


def latest_status(status: DataFrame) -> DataFrame:
    """Newest status row per agent: (AgentCode, Status, TotalTalkTime, LastUpdatedOn).

    The newest (time, event id) of each (agent, status) is found by hash aggregation (both
    maxima are primitive); the newest of an agent's few statuses is then picked."""
    per = newest_per(status, ["AgentCode", "Status"], ["TotalTalkTime"])
    return pick_newest(per, ["AgentCode"], ["Status", "TotalTalkTime"]).withColumnRenamed("ts", "LastUpdatedOn")


def with_status(agents: DataFrame, status_latest: DataFrame, how: str = "left") -> DataFrame:
    s = status_latest.withColumnRenamed("AgentCode", "lead_agentid")
    return agents.join(s, "lead_agentid", how)


def _wanted(statuses: Sequence[str] | None):
    wanted = [s.upper() for s in (statuses or DEFAULT_ACTIVE_STATUSES)]
    return F.upper(F.col("Status")).isin(wanted)


def status_summary(leads: DataFrame | Facts, status: DataFrame, as_of, statuses: Sequence[str] | None = None,
                   products: Sequence[int] | None = None) -> DataFrame:
    """Per product: active agents checked and how many are in the wanted statuses now."""
    joined = with_status(active_pairs(leads, as_of, products), latest_status(status))
    return joined.groupBy("investmenttypeid").agg(
        F.count(F.lit(1)).alias("agents"),
        F.count_if(F.coalesce(_wanted(statuses), F.lit(False))).alias("in_status"))


def status_breakdown(leads: DataFrame | Facts, status: DataFrame, as_of,
                     products: Sequence[int] | None = None) -> DataFrame:
    """Agents per product and upper-cased status (agents without a status are skipped)."""
    joined = with_status(active_pairs(leads, as_of, products), latest_status(status), how="inner")
    return joined.groupBy("investmenttypeid", F.upper("Status").alias("status")).agg(
        F.count(F.lit(1)).alias("agents"))


def status_details(leads: DataFrame | Facts, status: DataFrame, as_of, statuses: Sequence[str] | None = None,
                   products: Sequence[int] | None = None) -> DataFrame:
    """One row per active agent in the wanted statuses, blank fields as NULL."""
    joined = with_status(active_pairs(leads, as_of, products), latest_status(status), how="inner")
    blank_null = F.when(F.trim(F.col("Status")) != F.lit(""), F.col("Status"))
    return (joined.where(_wanted(statuses))
            .select("investmenttypeid", "lead_agentid", blank_null.alias("Status"), "TotalTalkTime",
                    "LastUpdatedOn"))
