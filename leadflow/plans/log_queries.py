"""Message-log jobs, feedback / rule log and alert subscriptions (sections 2.12 - 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import feedback as FB
from ..operators import messages as MS
from ..functions.products import ALL_PRODUCTS_PHRASES
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF, NOW
from .catalog import register
from .sql import with_views

MSGS = with_views("messages")
NOW_SQL = "TIMESTAMP '2000-06-12 09:00:00'"


def _v(spark, sf, name):
    return fx.view(spark, sf, name)


def _contains_any_sql(text: str, needles) -> str:
    return "(" + " OR ".join("contains(" + text + ", '" + n.replace("'", "''") + "')" for n in needles) + ")"


# ---------------------------------------------------------------- 2.12 message log

@register("x_product_tags", oracle=with_views("messages", "aliases") + f"""
SELECT DISTINCT m.msg_id, a.product_id
FROM messages m CROSS JOIN aliases a
WHERE length(a.alias) >= 3
  AND NOT {_contains_any_sql('lower(m.text)', ALL_PRODUCTS_PHRASES)}
  AND regexp_matches(lower(m.text), '\\b' || lower(a.alias) || '\\b')
""")
def x_product_tags(spark, sf):
    """Product ids whose alias occurs as a whole word/phrase in each message (none for 'all products')."""
    return MS.product_tags(_v(spark, sf, "messages"), _v(spark, sf, "aliases"))


@register("x_agent_codes", oracle=MSGS + r"""
SELECT DISTINCT msg_id, code FROM (
  SELECT msg_id, unnest(regexp_extract_all(text, '\b[A-Za-z]{1,6}\d{2,8}\b')) AS code FROM messages) t
""")
def x_agent_codes(spark, sf):
    """Every distinct agent code (letters then digits, whole word) in each message."""
    return MS.agent_codes(_v(spark, sf, "messages"))


#: Words and phrases of the test texts' languages, as aliases for tagging real-length texts.
TEXT_ALIASES = [("the", 1), ("of the", 2), ("und der", 3), ("l\u00e9", 4), ("que", 5), ("\u00f3ci", 6), ("st ed", 7)]
_W = r"[\p{L}\p{M}\p{N}_]"


def _tags_text_sql() -> str:
    aliases = ", ".join(f"('{a}', {p})" for a, p in TEXT_ALIASES)
    return f"""
SELECT DISTINCT doc_id AS msg_id, product_id FROM documents, (VALUES {aliases}) AS a(alias, product_id)
WHERE NOT {_contains_any_sql('lower(text)', ALL_PRODUCTS_PHRASES)}
  AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || alias || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')
"""


@register("x_tags_documents", oracle=_tags_text_sql())
def x_tags_documents(spark, sf):
    """Aliases of several scripts and a very common one found as whole words in every document."""
    docs = fx.read_table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    return MS.product_tags(docs, spark.createDataFrame(TEXT_ALIASES, "alias string, product_id int"), min_alias_len=2)


ROUTE_SQL = (r"CASE WHEN length(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 2 "
             "THEN 'simple_metric' WHEN " + _contains_any_sql("lower(text)", MS.LOGIC_KEYWORDS)
             + " THEN 'business_logic' ELSE 'simple_metric' END")


@register("x_route", oracle=MSGS + f"SELECT msg_id, {ROUTE_SQL} AS route FROM messages")
def x_route(spark, sf):
    """Route label of every message (short -> simple metric; logic keyword -> business logic)."""
    return MS.routes(_v(spark, sf, "messages"))


@register("x_route_conversations", oracle="SELECT conv_id, turn, " + ROUTE_SQL + " AS route FROM conversations")
def x_route_conversations(spark, sf):
    """Route label of every conversation turn."""
    return fx.read_table(spark, sf, "conversations").select("conv_id", "turn", MS.route(F.col("text")).alias("route"))


@register("x_feedback_conversations", oracle="SELECT conv_id, turn, "
          + _contains_any_sql("lower(text)", MS.FEEDBACK_WORDS) + " AS is_feedback FROM conversations")
def x_feedback_conversations(spark, sf):
    """Feedback flag of every conversation turn."""
    return fx.read_table(spark, sf, "conversations").select("conv_id", "turn",
                                                            MS.feedback_like(F.col("text")).alias("is_feedback"))


@register("x_route_counts", oracle=MSGS + f"SELECT {ROUTE_SQL} AS route, COUNT(*) AS messages FROM messages GROUP BY 1")
def x_route_counts(spark, sf):
    """Messages per route."""
    return MS.route_counts(_v(spark, sf, "messages"))


def _rule_sql() -> str:
    parts = []
    for p in MS.RULE_PHRASES:
        pos = f"instr(lower(text), '{p}')"
        parts.append(f"CASE WHEN {pos} > 0 THEN regexp_replace(substring(text, {pos} + {len(p)}), "
                     r"'^\s+|\s+$', '', 'g') END")
    return "coalesce(" + ", ".join(parts) + ")"


@register("x_rule_capture", oracle=MSGS + f"""
SELECT msg_id, user_id, rule_text FROM (SELECT msg_id, user_id, {_rule_sql()} AS rule_text FROM messages) t
WHERE rule_text IS NOT NULL AND rule_text <> ''
""")
def x_rule_capture(spark, sf):
    """Rule text after 'remember that' (or one of three similar phrases; first in list order wins)."""
    return MS.rules(_v(spark, sf, "messages"))


@register("x_feedback_like", oracle=MSGS + "SELECT msg_id, "
          + _contains_any_sql("lower(text)", MS.FEEDBACK_WORDS) + " AS is_feedback FROM messages")
def x_feedback_like(spark, sf):
    """Flag of every message: does it contain one of the 21 feedback words?"""
    m = _v(spark, sf, "messages")
    return m.select("msg_id", MS.feedback_like(F.col("text")).alias("is_feedback"))


# ---------------------------------------------------------------- 2.13 feedback and rules

FEEDBACK = with_views("feedback_items", "feedback_decisions", extra="""
last AS (SELECT id, max_by(decision, (ts, event_id)) AS decision, max(ts) AS decided_at
         FROM feedback_decisions GROUP BY id),
status AS (SELECT i.id, coalesce(l.decision, 'pending') AS status, l.decided_at
           FROM feedback_items i LEFT JOIN last l ON l.id = i.id),
approved AS (SELECT i.id, i.sql_text, s.decided_at AS approved_at FROM feedback_items i JOIN status s ON s.id = i.id
             WHERE s.status = 'approved' AND i.sql_text IS NOT NULL),
early_last AS (SELECT id, max_by(decision, (ts, event_id)) AS decision, max(ts) AS decided_at
               FROM feedback_decisions WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY id),
existing AS (SELECT i.id, i.sql_text, e.decided_at AS approved_at FROM feedback_items i JOIN early_last e ON e.id = i.id
             WHERE e.decision = 'approved' AND i.sql_text IS NOT NULL)
""")
CUTOFF = "2024-01-15 00:00:00"


def _existing_rules(spark, sf):
    """The rule table as a first promotion run (decisions before the cut-off) left it."""
    items, dec = _v(spark, sf, "feedback_items"), _v(spark, sf, "feedback_decisions")
    early = dec.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return FB.approved_rules(items, early)


@register("r_apply_decisions", oracle=FEEDBACK + "SELECT id, status, decided_at FROM status")
def r_apply_decisions(spark, sf):
    """Status of every feedback item from its newest approve/reject decision (pending if none)."""
    return FB.apply_decisions(_v(spark, sf, "feedback_items"), _v(spark, sf, "feedback_decisions"))


@register("r_promote_approved", oracle=FEEDBACK + """
SELECT id, sql_text, approved_at FROM existing
UNION ALL
SELECT a.id, a.sql_text, a.approved_at FROM approved a WHERE a.id NOT IN (SELECT id FROM existing)
""")
def r_promote_approved(spark, sf):
    """Rule table after a second promotion run: approved items with SQL added once each."""
    items, dec = _v(spark, sf, "feedback_items"), _v(spark, sf, "feedback_decisions")
    return FB.promote(_existing_rules(spark, sf), items, dec)


@register("j_unpromoted_rules", oracle=FEEDBACK + """
SELECT a.id, a.sql_text, a.approved_at FROM approved a
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.id = a.id)
""")
def j_unpromoted_rules(spark, sf):
    """Approved items with SQL not yet in the rule table (left anti join)."""
    items, dec = _v(spark, sf, "feedback_items"), _v(spark, sf, "feedback_decisions")
    return FB.unpromoted(FB.approved_rules(items, dec), _existing_rules(spark, sf))


@register("r_status_counts", oracle=FEEDBACK + "SELECT status, COUNT(*) AS items FROM status GROUP BY status")
def r_status_counts(spark, sf):
    """Feedback items per status."""
    return FB.status_counts(_v(spark, sf, "feedback_items"), _v(spark, sf, "feedback_decisions"))


@register("r_merge_corrections", oracle=with_views("corrections") + """
SELECT session_id,
       max_by(metric, seq) FILTER (WHERE metric IS NOT NULL) AS metric,
       max_by(time_key, seq) FILTER (WHERE time_key IS NOT NULL) AS time_key,
       array_to_string(list_sort(list(DISTINCT filter_value) FILTER (WHERE filter_value IS NOT NULL)), ',')
         AS filter_values
FROM corrections GROUP BY session_id
""")
def r_merge_corrections(spark, sf):
    """Per session: newest non-null metric and window; accumulated distinct filter values."""
    return FB.merge_corrections(_v(spark, sf, "corrections"))


# ---------------------------------------------------------------- 2.14 alert subscriptions

def _next_run_sql(t: str) -> str:
    day = f"date_trunc('day', {t})"
    return (f"CASE frequency WHEN 'hourly' THEN {t} + INTERVAL 1 HOUR "
            f"WHEN 'daily' THEN CASE WHEN {t} >= {day} + INTERVAL 9 HOUR THEN {day} + INTERVAL 33 HOUR "
            f"ELSE {day} + INTERVAL 9 HOUR END "
            f"WHEN 'weekly' THEN {day} + to_days(CAST(CASE WHEN (8 - isodow({t})) % 7 = 0 AND hour({t}) >= 9 THEN 7 "
            f"ELSE (8 - isodow({t})) % 7 END AS INTEGER)) + INTERVAL 9 HOUR "
            f"ELSE {t} + INTERVAL 1 DAY END")


SUBS = with_views("subscriptions", extra=f"""
sched AS (SELECT id, user_id, frequency, last_run_at, product_id, metric, {_next_run_sql('last_run_at')} AS next_run_at
          FROM subscriptions)
""")


def _sched(spark, sf):
    return AL.with_next_run(_v(spark, sf, "subscriptions"))


@register("b_next_run", oracle=SUBS + "SELECT id, frequency, last_run_at, next_run_at FROM sched")
def b_next_run(spark, sf):
    """Next run of every subscription from its last run (hourly / daily 09:00 / Monday 09:00 / +1 day)."""
    return _sched(spark, sf).select("id", "frequency", "last_run_at", "next_run_at")


@register("b_due", oracle=SUBS + f"SELECT * FROM sched WHERE next_run_at IS NOT NULL AND next_run_at <= {NOW_SQL}")
def b_due(spark, sf):
    """Subscriptions due at Monday 2000-06-12 09:00."""
    return AL.due(_sched(spark, sf), NOW)


@register("b_by_user", oracle=SUBS + "SELECT * FROM sched WHERE user_id = 7")
def b_by_user(spark, sf):
    """The subscriptions of user 7."""
    return AL.by_user(_sched(spark, sf), 7)


@register("b_advance", oracle=SUBS + f"""
SELECT id, user_id, frequency,
       CASE WHEN next_run_at <= {NOW_SQL} THEN {NOW_SQL} ELSE last_run_at END AS last_run_at,
       product_id, metric,
       CASE WHEN next_run_at <= {NOW_SQL} THEN {_next_run_sql(NOW_SQL)} ELSE next_run_at END AS next_run_at
FROM sched
""")
def b_advance(spark, sf):
    """After a run at 2000-06-12 09:00: due subscriptions get a new last and next run."""
    return AL.advance(_sched(spark, sf), NOW)


@register("b_evaluate_due", oracle=with_views("subscriptions", "leads", extra=f"""
sched AS (SELECT id, user_id, frequency, last_run_at, product_id, metric, {_next_run_sql('last_run_at')} AS next_run_at
          FROM subscriptions),
m AS (SELECT CAST(investmenttypeid AS BIGINT) AS product_id,
             COUNT(*) FILTER (WHERE leaddate >= DATE '2000-06-01') AS leads,
             COUNT(*) FILTER (WHERE bookingdate >= DATE '2000-06-01' AND booking_status = 'IssuedBusiness') AS bookings
      FROM leads GROUP BY 1),
mt AS (SELECT product_id, 'leads' AS metric, leads AS value FROM m
       UNION ALL SELECT product_id, 'bookings' AS metric, bookings AS value FROM m)
""") + f"""
SELECT s.id, s.user_id, s.product_id, s.metric, coalesce(mt.value, 0) AS value
FROM sched s LEFT JOIN mt ON mt.product_id = s.product_id AND mt.metric = s.metric
WHERE s.next_run_at <= {NOW_SQL}
""")
def b_evaluate_due(spark, sf):
    """Metric (this month's leads or bookings of the product) of every due subscription, one pass."""
    return AL.evaluate_due(_sched(spark, sf), fx.leads(spark, sf), NOW, "this_month", AS_OF)
