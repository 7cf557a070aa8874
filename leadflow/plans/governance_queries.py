"""Masking and profiling (inventory sections 2.10 and 2.11)."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masking as MK
from ..operators.names import NAME_COLUMNS_6, NAME_COLUMNS_8, unpivot_names
from ..session import scratch_path
from ..sources import io
from ..functions import metrics as M
from ..functions import windows as W
from ..operators.agents import suggest
from ..operators.masking import declare, mask
from ..operators.query import metric_query
from ..operators import profiling as PR
from ..sources import fixtures as fx
from ..sources.schema import CATALOG_BY_NAME
from .catalog import register
from .agent_queries import QUERIES_VIEW, TRIGRAM_GUARD, _norm, _pool_sql, _score
from .sql import BOOKED, CONV, money, with_views

LEADS = with_views("leads")


def _leads(spark, sf):
    return fx.leads(spark, sf)


def _hash_sql(c: str) -> str:
    return f"substring(sha256(CAST({c} AS VARCHAR)), 1, 12)"


def _pick_sql(values, c: str) -> str:
    arr = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{arr}[('0x' || sha256(CAST({c} AS VARCHAR))[1:8])::BIGINT % {len(values)} + 1]"


def _fake_sql(c: str, is_date: bool) -> str:
    if is_date:
        return "CAST(NULL AS DATE)"
    kind = MK.fake_kind(c)
    idx = lambda n: f"(('0x' || sha256(CAST({c} AS VARCHAR))[1:8])::BIGINT % {n} + 1)"
    expr = {
        "company": _pick_sql(MK.FAKE_COMPANIES, c),
        "name": _pick_sql(MK.FAKE_NAMES, c),
        "email": f"concat('user', CAST({idx(1000)} AS VARCHAR), '@example.com')",
        "phone": f"concat('555-', lpad(CAST({idx(10000)} AS VARCHAR), 4, '0'))",
        "place": _pick_sql(MK.FAKE_PLACES, c),
        "word": _pick_sql(MK.FAKE_WORDS, c),
    }[kind]
    return f"CASE WHEN {c} IS NOT NULL THEN {expr} END"


HASH_COLS = ("customerid", "referralid", "leadcreationsource")
FAKE_COLS = ("leadassignedagentname", "contact_person_name", "city", "state", "insurername", "leaddate")


@register("k_hash", oracle=LEADS + "SELECT leadid, " + ", ".join(f"{_hash_sql(c)} AS {c}" for c in HASH_COLS)
          + " FROM leads")
def k_hash(spark, sf):
    """First 12 hex digits of SHA-256 of the text form (NULL stays NULL)."""
    return _leads(spark, sf).select("leadid", *[MK.hash12(c).alias(c) for c in HASH_COLS])


@register("k_redact", oracle=LEADS + "SELECT leadid, '[REDACTED]' AS booking_status FROM leads")
def k_redact(spark, sf):
    """Constant [REDACTED] for every row (NULLs too)."""
    return _leads(spark, sf).select("leadid", MK.redact().alias("booking_status"))


@register("k_fake", oracle=LEADS + "SELECT leadid, " + ", ".join(
    f"{_fake_sql(c, c == 'leaddate')} AS {c}" for c in FAKE_COLS) + " FROM leads")
def k_fake(spark, sf):
    """Stand-in values by column name (person names, places), stable per value; dates become NULL."""
    df = _leads(spark, sf)
    return df.select("leadid", *[MK.fake(c, df.schema[c].dataType).alias(c) for c in FAKE_COLS])


def _policy_sql() -> str:
    cols = []
    for name in LEADS_COLUMNS:
        spec = CATALOG_BY_NAME.get(name)
        pii, strategy = (spec.pii_level, spec.masking_strategy) if spec else ("none", "none")
        if pii == "none" or strategy == "none":
            cols.append(name)
        elif strategy == "hash":
            cols.append(f"{_hash_sql(name)} AS {name}")
        elif strategy == "redact":
            cols.append(f"'[REDACTED]' AS {name}")
        else:
            cols.append(f"{_fake_sql(name, spec.type_name == 'date')} AS {name}")
    return LEADS + "SELECT " + ", ".join(cols) + " FROM leads"


LEADS_COLUMNS = ("leadid customerid investmenttypeid referralid leaddate bookingdate booking_status "
                 "leadassignedagentname currentlyassigneduser leadreportingmanagername leadreportingmanagername2 "
                 "first_assigned_agent booking_agent booking_agent_manager booking_agent_manager2 lead_agentid "
                 "contact_person_name state city productname mkt_category leadcreationsource insurername "
                 "paymentstatus is_lead_hybrid premium revenue brokerage suminsured totalnooflives "
                 "insurerfullname booking_occupancy lead_occupancy policystartdate").split()


@register("k_mask_policy", oracle=_policy_sql())
def k_mask_policy(spark, sf):
    """The whole fact view masked column by column from its schema metadata."""
    return mask(_leads(spark, sf))


def _fake_of(kind_col: str, value: str) -> str:
    """The stand-in of ``value`` from the family of the source column ``kind_col``."""
    return _fake_sql(kind_col, False).replace(f"CAST({kind_col} AS VARCHAR)", f"CAST({value} AS VARCHAR)").replace(
        f"CASE WHEN {kind_col} IS", f"CASE WHEN {value} IS")


@register("k_mask_expressions", oracle=LEADS + f"""
SELECT leadid, {_fake_of('contact_person_name', 'upper(contact_person_name)')} AS shouted, '[REDACTED]' AS who_where,
       {_fake_of('city', 'last_city')} AS last_city, n_names, {_fake_of('city', 'city')} AS place
FROM (SELECT *, max(city) OVER (PARTITION BY investmenttypeid) AS last_city,
             count(contact_person_name) OVER (PARTITION BY investmenttypeid) AS n_names FROM leads) t
""")
def k_mask_expressions(spark, sf):
    """Computed columns masked by what they read: one protected column keeps its treatment, a mix
    is redacted, counts are open."""
    w = Window.partitionBy("investmenttypeid")
    return mask(_leads(spark, sf).select(
        "leadid", F.upper("contact_person_name").alias("shouted"),
        F.concat_ws("@", "contact_person_name", "customerid").alias("who_where"), F.max("city").over(w).alias("last_city"),
        F.count("contact_person_name").over(w).alias("n_names"), F.col("city").alias("place")))


@register("k_mask_unpivot", oracle=LEADS + "SELECT leadid, source_col, " + _fake_of("leadassignedagentname", "name")
          + " AS name FROM (" + " UNION ALL ".join(
              f"SELECT leadid, '{c}' AS source_col, {c} AS name FROM leads" for c in NAME_COLUMNS_6)
          + ") u WHERE name IS NOT NULL AND trim(name) <> ''")
def k_mask_unpivot(spark, sf):
    """Name columns melted into one are masked by the policy they share."""
    return mask(unpivot_names(_leads(spark, sf), NAME_COLUMNS_6))


@register("k_mask_metrics", oracle=LEADS + f"""
SELECT CAST(date_trunc('month', leaddate) AS DATE) AS month, {_pick_sql(MK.FAKE_PLACES, 'state')} AS state,
       COUNT(*) AS leads, {BOOKED} AS bookings, {money('revenue')} AS total_revenue, {money('premium')} AS total_premium,
       {money('brokerage')} AS total_brokerage, {CONV} AS conversion_rate,
       {money('premium')} / NULLIF(COUNT(premium), 0) AS avg_premium, {money('suminsured')} AS total_sum_insured,
       CAST(SUM(totalnooflives) AS BIGINT) AS total_lives
FROM leads GROUP BY CAST(date_trunc('month', leaddate) AS DATE), state
""")
def k_mask_metrics(spark, sf):
    """All nine metrics by month and state, masked: numbers and months stay, the state gets a stand-in."""
    parts = [m for m in M.METRICS if m != "bookings"]            # asked for with bookings, the axis is the booking date
    by_lead = metric_query(_leads(spark, sf), parts, dims=["state"], bucket="month")
    booked = _leads(spark, sf).groupBy(W.bucket("leaddate", "month").alias("month"), "state").agg(M.metric("bookings"))
    return mask(by_lead.join(booked, ["month", "state"]))


@register("k_mask_suggest", oracle=QUERIES_VIEW + f"""
, q AS (SELECT q_id, q_name, trim(lower(q_name)) AS q_norm FROM name_queries),
p AS (SELECT name, {_norm('name')} AS p_norm FROM ({_pool_sql(NAME_COLUMNS_8)}) x),
s AS (SELECT q_id, q_name, q_norm, name, p_norm, {_score('q_norm', 'p_norm')} AS score FROM q CROSS JOIN p),
t AS (SELECT q_id, q_name, name, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, name) AS rank
      FROM s WHERE score >= 85 AND {TRIGRAM_GUARD} QUALIFY rank <= 5)
SELECT q_id, q_name, {_pick_sql(MK.FAKE_NAMES, 'name')} AS name, score, rank FROM t
""")
def k_mask_suggest(spark, sf):
    """Name suggestions, masked: the typed text and the scores stay, the names found get stand-ins."""
    return mask(suggest(_leads(spark, sf), declare(fx.view(spark, sf, "name_queries"))))


@register("export_csv_masked", oracle=LEADS + "SELECT leadid, " + _fake_of("contact_person_name", "contact_person_name")
          + " AS contact, " + _hash_sql("customerid") + " AS customer FROM leads")
def export_csv_masked(spark, sf):
    """An export is masked unless asked for raw; read back from CSV."""
    rows = _leads(spark, sf).select("leadid", F.col("contact_person_name").alias("contact"),
                                    F.col("customerid").alias("customer"))
    path = io.export_csv(rows, scratch_path(spark, "exports", unique=True))
    return io.read_export(spark, path, T.StructType.fromDDL("leadid long, contact string, customer string"))


PROFILED = [c for c in PR.PROFILE_COLUMNS if c in LEADS_COLUMNS]


@register("d_distinct_values", oracle=LEADS + "SELECT column_name, value, rank FROM (SELECT column_name, value, "
          "row_number() OVER (PARTITION BY column_name ORDER BY value) AS rank FROM (SELECT DISTINCT column_name, value FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM leads" for c in PROFILED)
          + ") u WHERE value IS NOT NULL AND value <> '' AND lower(value) <> 'null') d) r WHERE rank <= 100")
def d_distinct_values(spark, sf):
    """Up to 100 distinct non-empty values of each profiled column, in one scan."""
    return PR.distinct_values(_leads(spark, sf))


SAMPLED = [c for c in LEADS_COLUMNS if c in CATALOG_BY_NAME and CATALOG_BY_NAME[c].categorical]


@register("d_value_samples", oracle=LEADS + "SELECT column_name, array_to_string(list_sort(list(value)), ', ') AS samples "
          "FROM (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rank FROM "
          "(SELECT DISTINCT column_name, value FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM leads" for c in SAMPLED)
          + ") u WHERE value IS NOT NULL AND value <> '' AND lower(value) <> 'null') d) r WHERE rank <= 8 "
          "GROUP BY column_name")
def d_value_samples(spark, sf):
    """First 8 distinct values of every categorical column, as one text per column."""
    return PR.value_samples(_leads(spark, sf), SAMPLED, 8)
