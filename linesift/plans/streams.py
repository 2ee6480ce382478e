"""Registered streaming queries (S8, W4, W5, W6): the ``events`` table replayed
as a stream (file source, ``availableNow``) must give the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.runner import drain, fold_sink, fresh_folder, read_sink, run_into
from ..streaming.sessions import open_sessions, stream_assign_sessions, stream_savings, stream_sessions
from . import sessions as batch_sessions
from .catalog import ORACLE, register, rounded, sql_effective, sql_invocations, with_ctes
from .inputs import table


def events_stream(spark, sf_dir):
    """S8 over the driver's parquet: the events file as a stream source."""
    schema = table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/")))


@register("stream_sessions", f"""
WITH _f AS (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS _p FROM events
),
_n AS (
  SELECT *, sum(CASE WHEN _p IS NULL OR epoch_us(ts) - epoch_us(_p) > {batch_sessions.GAP_SECONDS * 1_000_000} THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM _f
)
SELECT *, session_end > (SELECT max(ts) FROM events) AS open FROM (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {batch_sessions.GAP_SECONDS} SECOND AS session_end,
         CAST(count(*) AS BIGINT) AS events, min(ts) AS first_ts, max(ts) AS last_ts
  FROM _n GROUP BY user_id, s)""")
def stream_sessions_q(spark, sf_dir):
    """Session windows (6 h gap) per user over the replayed stream in append mode:
    the sessions that the watermark closed, and those that the state still holds,
    flagged ``open``."""
    s = stream_sessions(events_stream(spark, sf_dir), "user_id", gap_seconds=batch_sessions.GAP_SECONDS, watermark="0 seconds")
    run = run_into(spark, s, fresh_folder(spark, "w4"))
    closed = read_sink(spark, run.folder, s.schema).withColumn("open", F.lit(False))
    res = closed.unionByName(open_sessions(spark, run.checkpoint, "user_id").withColumn("open", F.lit(True)))
    return res.withColumns({c: F.col(c).cast("timestamp_ntz")
                            for c in ("session_start", "session_end", "first_ts", "last_ts")})


@register("stream_user_sessions", ORACLE["sessionize"])
def stream_user_sessions(spark, sf_dir):
    """The batch rule (gap + context) decided online; equals ``sessionize``."""
    ev = events_stream(spark, sf_dir).withColumn(
        "context_root", F.when(F.col("event_type") == "signup", "onboarding").otherwise("product"))
    s = stream_assign_sessions(ev.select("event_id", "user_id", "ts", "context_root"), "user_id",
                               gap_seconds=batch_sessions.GAP_SECONDS, context_col="context_root",
                               order_col="event_id")
    res = drain(spark, s, "append", "w5")
    return res.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "context_root", "is_new",
                      "session_no", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "session_id")


@register("stream_savings", with_ctes(sql_invocations(), sql_effective("inv")) + """
SELECT strftime(ts, '%Y-%m-%d') AS day, command, CAST(count(*) AS BIGINT) AS calls,
       CAST(sum(stdout_lines) AS BIGINT) AS raw_lines, CAST(sum(eff_lines) AS BIGINT) AS effective_lines,
       CAST(sum(stdout_bytes) AS BIGINT) AS raw_bytes, round(sum(eff_bytes), 4) AS effective_bytes_estimate,
       CAST(count(*) FILTER (WHERE "full") AS BIGINT) AS full_calls
FROM eff2 GROUP BY 1, 2""")
def stream_savings_q(spark, sf_dir):
    """S8 + W6: running savings per day and command over the replayed log."""
    ev = events_stream(spark, sf_dir)
    k = F.regexp_extract("props", '"k":\\s*(-?\\d+)', 1).try_cast("long")
    inv = ev.select(
        "ts", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("command"), F.floor(F.col("value") * 100).cast("long").alias("stdout_bytes"),
        k.alias("stdout_lines"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("long"))
         .when(F.col("event_type") == "click", k).otherwise(F.floor(k / 2).cast("long")).alias("compressed_lines"),
        ((F.col("event_type") == "error") & (k < 10)).alias("full"))
    res = drain(spark, stream_savings(inv), "update", "w6", latest_by=["day", "command"])
    return rounded(res)


@register("stream_log_savings", ORACLE["stream_savings"])
def stream_log_savings(spark, sf_dir):
    """K1 -> S8 -> W6: the invocation log written as JSON folders per day,
    tailed as a file stream into a sink that keeps each group's last version."""
    from ..sources.logs import stream_invocations
    from .edges import _write_log
    path = _write_log(spark, sf_dir)
    res = stream_savings(stream_invocations(spark, path, max_files_per_trigger=64))
    folder = fresh_folder(spark, "w6log")
    run_into(spark, res, folder, "update")
    fold_sink(spark, folder, res.schema, ["day", "command"])
    return rounded(read_sink(spark, folder, res.schema, "update", ["day", "command"]))
