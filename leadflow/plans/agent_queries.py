"""Joins, agent resolution and status roll-ups (inventory sections 2.8 and 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import names as N
from ..functions import text as TX
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from .catalog import register
from .sql import with_views

ACTIVE = ("lead_agentid IS NOT NULL AND trim(lead_agentid) <> '' AND booking_status = 'IssuedBusiness' "
          "AND bookingdate >= CAST(date_trunc('month', DATE '2000-06-14') - INTERVAL 1 MONTH AS DATE)")

LATEST_STATUS = """
latest AS (SELECT AgentCode, max_by(Status, (ts, event_id)) AS Status,
                  max_by(TotalTalkTime, (ts, event_id)) AS TotalTalkTime, max(ts) AS LastUpdatedOn
           FROM agent_status GROUP BY AgentCode),
active AS (SELECT DISTINCT investmenttypeid, lead_agentid FROM leads WHERE """ + ACTIVE + ")"

DEFAULT_SET = "('READY', 'AVAILABLE', 'IDLE', 'ONCALL', 'ON CALL', 'BUSY')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _tris(x: str) -> str:
    r = f"replace(lower({x}), ' ', '')"
    return f"list_distinct(list_transform(range(1, length({r}) - 1), lambda i: substring({r}, i, 3)))"


def _score(a: str, b: str) -> str:
    wa, wb = _words(a), _words(b)
    return (f"greatest(CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - levenshtein({a}, {b}) / "
            f"NULLIF(greatest(length({a}), length({b})), 0)), "
            f"CASE WHEN list_has_all({wb}, {wa}) OR list_has_all({wa}, {wb}) THEN CAST(100 AS DOUBLE) "
            f"ELSE CAST(100 AS DOUBLE) * length(list_intersect({wa}, {wb})) / "
            f"length(list_distinct(list_concat({wa}, {wb}))) END)")


TRIGRAM_GUARD = (f"(NOT (length(q_norm) >= 5 AND substring(p_norm, 1, 1) <> substring(q_norm, 1, 1)) "
                 f"OR (length({_tris('q_norm')}) > 0 AND length(list_intersect({_tris('q_norm')}, {_tris('p_norm')})) > 0))")
SINGLE_WORD_GUARD = f"(length({_words('q_norm')}) <> 1 OR contains(p_norm, q_norm))"


def _pool_sql(cols) -> str:
    parts = [f"SELECT {c} AS name FROM leads WHERE {c} IS NOT NULL AND trim({c}) <> ''" for c in cols]
    return "SELECT DISTINCT name FROM (" + " UNION ALL ".join(parts) + ") u"


def _any_equal(alias: str, target: str, cols) -> str:
    return "(" + " OR ".join(f"lower({alias}.{c}) = lower({target})" for c in cols) + ")"


def _leads(spark, sf):
    return fx.leads(spark, sf)


def _status(spark, sf):
    return fx.status(spark, sf)


# ---------------------------------------------------------------- 2.8 joins

@register("j_agent_status", oracle=with_views("leads", "agent_status", extra=LATEST_STATUS) + """
SELECT a.lead_agentid, s.Status, s.TotalTalkTime, s.LastUpdatedOn
FROM (SELECT DISTINCT lead_agentid FROM active) a LEFT JOIN latest s ON s.AgentCode = a.lead_agentid
""")
def j_agent_status(spark, sf):
    """Active agents left-joined to their newest status (replaces one status call per agent)."""
    agents = A.active_pairs(fx.facts(spark, sf, fx.BOOKED_COLUMNS), AS_OF).select("lead_agentid").distinct()
    return A.with_status(agents, A.latest_status(_status(spark, sf))).select(
        "lead_agentid", "Status", "TotalTalkTime", "LastUpdatedOn")


@register("j_names_to_codes", oracle=with_views("leads") + """
, wanted AS (SELECT DISTINCT currentlyassigneduser AS name FROM leads)
SELECT name, lead_agentid, last_dt FROM (
  SELECT w.name, l.lead_agentid, max(coalesce(l.bookingdate, l.leaddate)) OVER (PARTITION BY w.name) AS last_dt,
         row_number() OVER (PARTITION BY w.name ORDER BY coalesce(l.bookingdate, l.leaddate) DESC, l.lead_agentid) AS rn
  FROM wanted w JOIN leads l ON """ + _any_equal("l", "w.name", N.NAME_COLUMNS_6) + """
  WHERE l.lead_agentid IS NOT NULL AND trim(l.lead_agentid) <> '') t
WHERE rn = 1
""")
def j_names_to_codes(spark, sf):
    """Every distinct 'currently assigned user' name resolved to its newest agent id
    (lower-cased equality against the six agent columns), as one join + aggregate."""
    leads = _leads(spark, sf)
    wanted = leads.select(F.col("currentlyassigneduser").alias("name")).where(F.col("name").isNotNull()).distinct()
    return A.newest_codes(leads, wanted, N.NAME_COLUMNS_6)


QUERIES_VIEW = with_views("leads", "name_queries")


@register("j_fuzzy_names", oracle=QUERIES_VIEW + f"""
, q AS (SELECT q_id, {_norm('q_name')} AS q_norm FROM name_queries),
p AS (SELECT name, {_norm('name')} AS p_norm FROM ({_pool_sql(N.NAME_COLUMNS_8)}) x)
SELECT q_id, q_norm, name, p_norm, score FROM (
  SELECT q_id, q_norm, name, p_norm, {_score('q_norm', 'p_norm')} AS score FROM q CROSS JOIN p) s
WHERE score >= 85
""")
def j_fuzzy_names(spark, sf):
    """Every typed name paired with every known name scoring >= 85, found by a prefix-filtered
    equi-join on rare trigram/word tokens (no cross join; the oracle checks all pairs)."""
    q = fx.view(spark, sf, "name_queries").select("q_id", TX.norm_name("q_name").alias("q_norm"))
    return A.fuzzy_join(q, A.name_pool(_leads(spark, sf), N.NAME_COLUMNS_8), 85.0)


# ---------------------------------------------------------------- 2.9 agents and status

RESOLVE_NAME = "red widget"
RESOLVE_PRODUCTS = (1, 2, 3)
_CONTAINS8 = "(" + " OR ".join(f"coalesce(contains(lower({c}), '{RESOLVE_NAME}'), false)" for c in N.NAME_COLUMNS_8) + ")"


def _resolve_sql(products) -> str:
    return with_views("leads") + f"""
, base AS (SELECT *, coalesce(bookingdate, leaddate) AS d FROM leads
           WHERE lead_agentid IS NOT NULL AND trim(lead_agentid) <> '' AND {_CONTAINS8}),
s1 AS (SELECT 1 AS step, lead_agentid FROM base WHERE investmenttypeid IN {products} ORDER BY d DESC, lead_agentid LIMIT 1),
s2 AS (SELECT 2 AS step, lead_agentid FROM base ORDER BY d DESC, lead_agentid LIMIT 1)
SELECT '{RESOLVE_NAME}' AS query_name, lead_agentid, CASE step WHEN 1 THEN 'product' ELSE 'any' END AS resolved_by
FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) u ORDER BY step LIMIT 1
"""


@register("a_resolve_id", oracle=_resolve_sql(RESOLVE_PRODUCTS))
def a_resolve_id(spark, sf):
    """Agent id for 'red widget' in products 1-3: product match, else any match."""
    return A.resolve_agent_id(_leads(spark, sf), RESOLVE_NAME, RESOLVE_PRODUCTS)


@register("a_resolve_id_any", oracle=_resolve_sql((-1, -2)))
def a_resolve_id_any(spark, sf):
    """The same name, typed with blanks around it, in products that have no such row: any match."""
    return A.resolve_agent_id(_leads(spark, sf), f" {RESOLVE_NAME} ", (-1, -2))


@register("a_candidates", oracle=QUERIES_VIEW + f"""
, q AS (SELECT q_id, q_name, {_norm('q_name')} AS q_norm FROM name_queries),
p AS (SELECT name, {_norm('name')} AS p_norm FROM ({_pool_sql(N.NAME_COLUMNS_6)}) x),
s AS (SELECT q_id, q_name, q_norm, name, p_norm, {_score('q_norm', 'p_norm')} AS score FROM q CROSS JOIN p),
top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS rank
        FROM s WHERE score >= 88 AND {SINGLE_WORD_GUARD} AND {TRIGRAM_GUARD} QUALIFY rank <= 5),
names AS (SELECT DISTINCT name FROM top),
codes AS (SELECT name, lead_agentid FROM (
    SELECT n.name, l.lead_agentid,
           row_number() OVER (PARTITION BY n.name ORDER BY coalesce(l.bookingdate, l.leaddate) DESC, l.lead_agentid) AS rn
    FROM names n JOIN leads l ON {_any_equal('l', 'n.name', N.NAME_COLUMNS_6)}
    WHERE l.lead_agentid IS NOT NULL AND trim(l.lead_agentid) <> '') t WHERE rn = 1)
SELECT top.q_id, top.q_name, top.name, top.score, top.rank, codes.lead_agentid
FROM top JOIN codes ON codes.name = top.name
""")
def a_candidates(spark, sf):
    """For every typed name: known agent names scoring >= 88 (one-word queries must be contained;
    5+ letters with another first letter need a shared trigram), best 5, each with its newest id."""
    return A.candidates(_leads(spark, sf), fx.view(spark, sf, "name_queries"))


@register("a_suggest", oracle=QUERIES_VIEW + f"""
, q AS (SELECT q_id, q_name, trim(lower(q_name)) AS q_norm FROM name_queries),
p AS (SELECT name, {_norm('name')} AS p_norm FROM ({_pool_sql(N.NAME_COLUMNS_8)}) x),
s AS (SELECT q_id, q_name, q_norm, name, p_norm, {_score('q_norm', 'p_norm')} AS score FROM q CROSS JOIN p)
SELECT q_id, q_name, name, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS rank
FROM s WHERE score >= 85 AND {TRIGRAM_GUARD} QUALIFY rank <= 5
""")
def a_suggest(spark, sf):
    """For every typed name: closest names over the eight name columns scoring >= 85, best 5."""
    return A.suggest(_leads(spark, sf), fx.view(spark, sf, "name_queries"))


@register("a_active_ids", oracle=with_views("leads") + f"""
SELECT lead_agentid, COUNT(*) AS bookings, max(bookingdate) AS last_booking FROM leads WHERE {ACTIVE} GROUP BY 1
""")
def a_active_ids(spark, sf):
    """Agents with an issued booking since the first of the previous month."""
    return A.active_ids(fx.facts(spark, sf, fx.BOOKED_COLUMNS), AS_OF)


@register("a_status_summary", oracle=with_views("leads", "agent_status", extra=LATEST_STATUS) + f"""
SELECT a.investmenttypeid, COUNT(*) AS agents,
       COUNT(*) FILTER (WHERE upper(s.Status) IN {DEFAULT_SET}) AS in_status
FROM active a LEFT JOIN latest s ON s.AgentCode = a.lead_agentid
GROUP BY a.investmenttypeid
""")
def a_status_summary(spark, sf):
    """Per product: active agents and how many are READY/AVAILABLE/IDLE/ONCALL/ON CALL/BUSY now."""
    return A.status_summary(fx.facts(spark, sf, fx.BOOKED_COLUMNS), _status(spark, sf), AS_OF)


@register("a_status_breakdown", oracle=with_views("leads", "agent_status", extra=LATEST_STATUS) + """
SELECT a.investmenttypeid, upper(s.Status) AS status, COUNT(*) AS agents
FROM active a JOIN latest s ON s.AgentCode = a.lead_agentid
GROUP BY 1, 2
""")
def a_status_breakdown(spark, sf):
    """Active agents per product and status."""
    return A.status_breakdown(fx.facts(spark, sf, fx.BOOKED_COLUMNS), _status(spark, sf), AS_OF)


@register("a_status_details", oracle=with_views("leads", "agent_status", extra=LATEST_STATUS) + """
SELECT a.investmenttypeid, a.lead_agentid, CASE WHEN trim(s.Status) <> '' THEN s.Status END AS Status,
       s.TotalTalkTime, s.LastUpdatedOn
FROM active a JOIN latest s ON s.AgentCode = a.lead_agentid
WHERE upper(s.Status) IN ('PAUSE', 'BUSY')
""")
def a_status_details(spark, sf):
    """One row per active agent whose newest status is PAUSE or BUSY, with its status fields."""
    return A.status_details(fx.facts(spark, sf, fx.BOOKED_COLUMNS), _status(spark, sf), AS_OF, statuses=["pause", "busy"])
