"""Registered usage-report queries (A1-A12, S3) over ``events`` as an invocation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from .catalog import register, rounded, sql_effective, sql_invocations, sql_savings_cols, with_ctes
from .inputs import event_invocations

_INV = sql_invocations()
_EFF = with_ctes(_INV, sql_effective("inv"))


def _inv(spark, sf_dir):
    return event_invocations(spark, sf_dir)


@register("spend_by_command", with_ctes(_INV) + """
SELECT command, CAST(sum(stdout_bytes) AS BIGINT) AS stdout_bytes, CAST(sum(stdout_lines) AS BIGINT) AS stdout_lines,
       CAST(count(*) AS BIGINT) AS calls
FROM inv GROUP BY command""")
def spend_by_command(spark, sf_dir):
    """A1."""
    return U.spend_by_command(_inv(spark, sf_dir))


@register("invocation_count", with_ctes(_INV) + """
SELECT CAST(count(*) AS BIGINT) AS total_invocations FROM inv""")
def invocation_count(spark, sf_dir):
    """A5."""
    return U.invocation_count(_inv(spark, sf_dir))


@register("repeated_invocations", with_ctes(_INV) + """
SELECT command, array_to_string(args, ' ') AS args_text, n FROM (
  SELECT command, args, CAST(count(*) AS BIGINT) AS n FROM inv GROUP BY command, args HAVING count(*) > 1
  ORDER BY n DESC, command, args LIMIT 20)""")
def repeated_invocations(spark, sf_dir):
    """A2: top 20 repeated (command, args); args shown joined by spaces."""
    df = U.repeated_invocations(_inv(spark, sf_dir))
    return df.select("command", F.concat_ws(" ", "args").alias("args_text"), "n")


@register("bypass_by_session", with_ctes(_INV) + """
SELECT session_id, full_calls, total_calls, round(100.0::DOUBLE * full_calls / total_calls, 4) AS full_pct FROM (
  SELECT session_id, CAST(count(*) FILTER (WHERE "full") AS BIGINT) AS full_calls, CAST(count(*) AS BIGINT) AS total_calls
  FROM inv GROUP BY session_id) WHERE full_calls > 0""")
def bypass_by_session(spark, sf_dir):
    """A3."""
    return rounded(U.bypass_by_session(_inv(spark, sf_dir)))


@register("bypass_by_command", with_ctes(_INV) + """
SELECT command, full_calls, compacted_calls, total_calls, lines_saved,
       round(CAST(full_calls AS DOUBLE) / total_calls, 4) AS full_rate FROM (
  SELECT command,
         CAST(count(*) FILTER (WHERE "full") AS BIGINT) AS full_calls,
         CAST(count(*) FILTER (WHERE NOT "full" AND compressed_lines IS NOT NULL) AS BIGINT) AS compacted_calls,
         CAST(count(*) AS BIGINT) AS total_calls,
         CAST(coalesce(sum(stdout_lines - compressed_lines) FILTER (WHERE NOT "full" AND compressed_lines IS NOT NULL), 0)
              AS BIGINT) AS lines_saved
  FROM inv GROUP BY command) WHERE full_calls > 0 OR compacted_calls > 0""")
def bypass_by_command(spark, sf_dir):
    """A4."""
    return rounded(U.bypass_by_command(_inv(spark, sf_dir)))


@register("savings_total", _EFF + f"""
SELECT {sql_savings_cols()} FROM eff2""")
def savings_total(spark, sf_dir):
    """A6."""
    return rounded(U.savings(_inv(spark, sf_dir)))


@register("savings_by_command", _EFF + f"""
SELECT command, {sql_savings_cols()} FROM eff2 GROUP BY command""")
def savings_by_command(spark, sf_dir):
    """A7."""
    return rounded(U.savings_by_command(_inv(spark, sf_dir)))


@register("savings_rollup", _EFF + f"""
SELECT command, grouping(command) = 1 AS is_total, {sql_savings_cols()} FROM eff2 GROUP BY ROLLUP (command)""")
def savings_rollup(spark, sf_dir):
    """A6 + A7 in one scan (rollup)."""
    return rounded(U.savings_with_total(_inv(spark, sf_dir)))


@register("savings_by_session", _EFF + f"""
SELECT session_id AS key, {sql_savings_cols()}, min(ts) AS start, max(ts) AS "end" FROM eff2 GROUP BY session_id""")
def savings_by_session(spark, sf_dir):
    """A8 (and A12, the same plan for one run's session log)."""
    return rounded(U.savings_by_session(_inv(spark, sf_dir)))


@register("savings_by_day", _EFF + f"""
SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS key, {sql_savings_cols()}, min(ts) AS start, max(ts) AS "end"
FROM eff2 GROUP BY 1""")
def savings_by_day(spark, sf_dir):
    """A9."""
    return rounded(U.savings_by_day(_inv(spark, sf_dir)))


@register("savings_cube", _EFF + f"""
SELECT session_id AS key, command,
       CASE grouping(session_id, command) WHEN 0 THEN 'group_command' WHEN 1 THEN 'group' ELSE 'total' END AS level,
       {sql_savings_cols()}, min(ts) AS start, max(ts) AS "end"
FROM eff2 GROUP BY GROUPING SETS ((session_id, command), (session_id), ())""")
def savings_cube(spark, sf_dir):
    """A10: per session, per (session, command) and total in one scan."""
    return rounded(U.savings_cube(_inv(spark, sf_dir), F.col("session_id")))


_TOP_COLS = ", ".join(["key", *U.SAVINGS_COLS, "start", '"end"'])


@register("top_sessions", _EFF + f"""
SELECT {_TOP_COLS} FROM (
  SELECT session_id AS key, {sql_savings_cols()}, min(ts) AS start, max(ts) AS "end",
         (CAST(sum(stdout_bytes) AS DOUBLE) - sum(eff_bytes)) / 4.0::DOUBLE AS _saved
  FROM eff2 GROUP BY session_id)
ORDER BY _saved DESC, start ASC NULLS FIRST, key LIMIT 20""")
def top_sessions(spark, sf_dir):
    """The 20 sessions with most saved tokens."""
    groups = U.savings_by_session(_inv(spark, sf_dir))
    return rounded(U.top_groups(groups, 20))


@register("sessions_not_shown", with_ctes(_INV) + """
SELECT CAST(greatest(count(DISTINCT session_id) - 20, 0) AS BIGINT) AS more FROM inv""")
def sessions_not_shown(spark, sf_dir):
    """A11 footer: number of sessions beyond the top 20."""
    return U.groups_remaining(U.savings_by_session(_inv(spark, sf_dir)), 20)


@register("savings_in_window", with_ctes(_INV, """
win AS (SELECT * FROM inv WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00')""",
                                       sql_effective("win")) + f"""
SELECT command, {sql_savings_cols()} FROM eff2 GROUP BY command""")
def savings_in_window(spark, sf_dir):
    """S3 + A7: inclusive time bounds, then savings by command."""
    inv = U.filter_time(_inv(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-20 12:00:00")
    return rounded(U.savings_by_command(inv))
