"""Registered sessionization queries (W1-W3) over ``events``.

key = user_id, gap = 6 hours, context = 'onboarding' for signups else 'product'.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sessions import resolve_session_id, session_facts, sessionize
from .catalog import register
from .inputs import table

GAP_SECONDS = 6 * 3600


def _events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k":\\s*(-?\\d+)', 1).try_cast("long")
    return ev.select("event_id", "user_id", "ts", "event_type",
                     F.when(F.col("event_type") == "signup", "onboarding").otherwise("product").alias("context_root"),
                     F.when((F.col("event_type") == "error") & (k < 5), F.lit("manual")).alias("override_id"),
                     F.when(F.col("event_type") == "purchase",
                            F.concat(F.lit("thread-"), F.col("user_id").cast("string"))).alias("thread_id"))


_SQL_EV = """
ev AS (
  SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN 'onboarding' ELSE 'product' END AS context_root,
         CASE WHEN event_type = 'error' AND TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) < 5
              THEN 'manual' END AS override_id,
         CASE WHEN event_type = 'purchase' THEN 'thread-' || CAST(user_id AS VARCHAR) END AS thread_id
  FROM events
)"""


def _sql_sessionized(src: str) -> str:
    return f"""
_f AS (
  SELECT *, lag(ts) OVER w AS _pts, lag(context_root) OVER w AS _pctx
  FROM {src} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
_n AS (
  SELECT *, CASE WHEN _pts IS NULL THEN 1
                 WHEN epoch_us(ts) - epoch_us(_pts) > {GAP_SECONDS * 1_000_000} THEN 1
                 WHEN _pctx IS NOT NULL AND (context_root IS NULL OR _pctx <> context_root) THEN 1
                 ELSE 0 END AS _new
  FROM _f
),
sess AS (
  SELECT *, _new = 1 AS is_new,
         CAST(sum(_new) OVER w AS BIGINT) AS session_no,
         max(CASE WHEN _new = 1 THEN ts END) OVER w AS session_start
  FROM _n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
),
sess2 AS (
  SELECT *, md5(coalesce(CAST(user_id AS VARCHAR), '') || '|' || session_no || '|' || epoch_us(session_start)) AS session_id
  FROM sess
)"""


@register("sessionize", f"WITH {_SQL_EV.strip()},{_sql_sessionized('ev').strip()}" + """
SELECT event_id, user_id, ts, context_root, is_new, session_no, session_start, session_id FROM sess2""")
def sessionize_events(spark, sf_dir):
    """W1 on every event."""
    s = sessionize(_events(spark, sf_dir), "user_id", gap_seconds=GAP_SECONDS, context_col="context_root",
                   order_col="event_id")
    return s.select("event_id", "user_id", "ts", "context_root", "is_new", "session_no", "session_start",
                    "session_id")


@register("session_facts", f"WITH {_SQL_EV.strip()},{_sql_sessionized('ev').strip()}" + """
SELECT user_id, session_no, session_id, min(ts) AS started_at, max(ts) AS last_used_at,
       CAST(count(*) AS BIGINT) AS calls, last(context_root ORDER BY ts, event_id) AS last_context_root
FROM sess2 GROUP BY user_id, session_no, session_id""")
def session_facts_q(spark, sf_dir):
    """W1 + W2: one row per session."""
    s = sessionize(_events(spark, sf_dir), "user_id", gap_seconds=GAP_SECONDS, context_col="context_root",
                   order_col="event_id")
    return session_facts(s, "user_id", context_col="context_root", order_col="event_id")


@register("resolved_sessions", f"""WITH {_SQL_EV.strip()},
gapev AS (SELECT * FROM ev WHERE override_id IS NULL AND thread_id IS NULL),{_sql_sessionized('gapev').strip()}""" + """
SELECT event_id, session_id, 'gap' AS source FROM sess2
UNION ALL
SELECT event_id, coalesce(override_id, thread_id) AS session_id,
       CASE WHEN override_id IS NOT NULL THEN 'env' ELSE 'thread' END AS source
FROM ev WHERE override_id IS NOT NULL OR thread_id IS NOT NULL""")
def resolved_sessions(spark, sf_dir):
    """Explicit ids win; the rest is gap-sessionized."""
    r = resolve_session_id(_events(spark, sf_dir), "user_id", gap_seconds=GAP_SECONDS,
                           context_col="context_root", order_col="event_id")
    return r.select("event_id", "session_id", "source")


# Every 97th event has no user, every 101st no time.
_SQL_SPARSE = """
ev AS (
  SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 101 <> 0 THEN ts END AS ts,
         CASE WHEN event_type = 'signup' THEN 'onboarding' ELSE 'product' END AS context_root
  FROM events
),
timed AS (SELECT * FROM ev WHERE ts IS NOT NULL)"""


@register("sessionize_sparse", f"WITH {_SQL_SPARSE.strip()},{_sql_sessionized('timed').strip()}" + """
SELECT event_id, user_id, ts, is_new, session_no, session_start, session_id FROM sess2
UNION ALL
SELECT event_id, user_id, ts, false, NULL, NULL, NULL FROM ev WHERE ts IS NULL""")
def sessionize_sparse(spark, sf_dir):
    """W1 with missing users and times: every event comes out."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 101 != 0, F.col("ts")).alias("ts"),
        F.when(F.col("event_type") == "signup", "onboarding").otherwise("product").alias("context_root"))
    s = sessionize(ev, "user_id", gap_seconds=GAP_SECONDS, context_col="context_root", order_col="event_id")
    return s.select("event_id", "user_id", "ts", "is_new", "session_no", "session_start", "session_id")
