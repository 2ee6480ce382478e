"""Idle-gap sessionization in batch.

W1: per key, ordered by time, a new session starts when the idle gap since the
previous event is *greater* than ``gap_seconds`` (0 disables the rule) or when
the context changes (a NULL previous context is not a change; a change to NULL
is).  Events with a NULL key are one key; events without a time stay, without a
session (``session_no`` and ``session_id`` NULL).  W2: per-session facts.  W3: an explicit id (override, then thread id)
wins and such events take no part in gap sessions.

Plan: single-carry two-level scan.  Events are chunked by ``(key, time bucket)``
(``bucket_seconds``), so a hot key is spread over many tasks.  Inside a chunk
``lag`` decides every row but the first; a per-chunk summary (first/last time
and context, local session starts, latest start) decides the first rows and
the carried session number, and is joined back once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK_COL, materialize, null_safe_keys

# Fixed value of the reference: 30 minutes of idle time end a session.
DEFAULT_GAP_SECONDS = 30 * 60
DEFAULT_BUCKET_SECONDS = 24 * 3600


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _changed(prev_ctx: Column, ctx: Column) -> Column:
    return prev_ctx.isNotNull() & (ctx.isNull() | (prev_ctx != ctx))


def session_id_expr(key: Column, session_no: Column, start: Column) -> Column:
    """Deterministic id (stable under task retry): md5 of key, number and start."""
    return F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), session_no.cast("string"),
                             F.unix_micros(start.cast("timestamp")).cast("string")))


def sessionize(events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS,
               context_col: str | None = None, order_col: str | None = None,
               bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Add ``is_new``, ``session_no`` (1-based per key), ``session_start``
    and ``session_id`` to every event."""
    gap_us = int(gap_seconds) * 1_000_000
    ctx = F.col(context_col) if context_col else F.lit(None).cast("string")
    order = [F.col(ts)] + ([F.col(order_col)] if order_col else [])
    d = events.withColumns({"_ctx": ctx, "_us": _micros(F.col(ts)),
                            CHUNK_COL: F.floor(_micros(F.col(ts)) / F.lit(bucket_seconds * 1_000_000)).cast("long")})
    timeless = events.where(F.col(ts).isNull())
    d, keys = null_safe_keys(d.where(F.col(ts).isNotNull()), [key])
    d = d.repartition(*keys, CHUNK_COL)

    wc = Window.partitionBy(*keys, CHUNK_COL).orderBy(*order)
    rn = F.row_number().over(wc)
    idle = (F.col("_us") - F.lag("_us").over(wc) > gap_us) if gap_us > 0 else F.lit(False)
    local_new = (rn > 1) & (idle | _changed(F.lag("_ctx").over(wc), F.col("_ctx")))
    d = d.withColumns({"_rn": rn, "_lnew": local_new.cast("int")})
    upto = wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_lcum": F.sum("_lnew").over(upto),
                       "_lstart": F.max(F.when(F.col("_lnew") == 1, F.col(ts))).over(upto)})
    d = materialize(d)                    # read by the summary and the main branch

    summ = (d.groupBy(*keys, CHUNK_COL)
            .agg(F.min("_us").alias("_fus"), F.min_by("_ctx", F.struct(*order)).alias("_fctx"),
                 F.min(ts).alias("_fts"),
                 F.max("_us").alias("_lus"), F.max_by("_ctx", F.struct(*order)).alias("_lctx"),
                 F.sum("_lnew").alias("_nloc"), F.max("_lstart").alias("_mstart")))
    wk = Window.partitionBy(*keys).orderBy(CHUNK_COL)
    prev_us = F.lag("_lus").over(wk)
    first_idle = (F.col("_fus") - prev_us > gap_us) if gap_us > 0 else F.lit(False)
    first_new = prev_us.isNull() | first_idle | _changed(F.lag("_lctx").over(wk), F.col("_fctx"))
    summ = summ.withColumn("_fnew", first_new.cast("int"))
    summ = summ.withColumn("_cstart", F.coalesce(F.col("_mstart"), F.when(F.col("_fnew") == 1, F.col("_fts"))))
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, CHUNK_COL, "_fnew", "_fts",
                       F.coalesce(F.sum(F.col("_fnew") + F.col("_nloc")).over(before), F.lit(0)).alias("_carry"),
                       F.max("_cstart").over(before).alias("_pstart"))

    d = d.join(summ, [*keys, CHUNK_COL])
    is_new = F.when(F.col("_rn") == 1, F.col("_fnew") == 1).otherwise(F.col("_lnew") == 1)
    start = F.coalesce(F.col("_lstart"), F.when(F.col("_fnew") == 1, F.col("_fts")), F.col("_pstart"))
    d = d.withColumns({
        "is_new": is_new,
        "session_no": (F.col("_carry") + F.col("_fnew") + F.col("_lcum")).cast("long"),
        "session_start": start,
    })
    d = d.withColumn("session_id", session_id_expr(F.col(key), F.col("session_no"), F.col("session_start")))
    d = d.drop("_ctx", "_us", CHUNK_COL, "_rn", "_lnew", "_lcum", "_lstart", "_fnew", "_fts", "_carry", "_pstart", *keys)
    timeless = timeless.withColumns({
        "is_new": F.lit(False), "session_no": F.lit(None).cast("long"),
        "session_start": F.lit(None).cast(d.schema["session_start"].dataType), "session_id": F.lit(None).cast("string")})
    return d.unionByName(timeless)


def session_facts(sessions: DataFrame, key: str, ts: str = "ts", context_col: str | None = None,
                  extra_last: tuple[str, ...] = (), order_col: str | None = None) -> DataFrame:
    """One row per session: id, start, last use, calls, last context (of
    events at one time the last by ``order_col``).  Events without a session take
    no part.  (Partial aggregation: a hot session is combined map-side.)"""
    last = F.struct(ts, order_col) if order_col else F.col(ts)
    sessions = sessions.where(F.col("session_no").isNotNull())
    aggs = [F.min(ts).alias("started_at"), F.max(ts).alias("last_used_at"), F.count(F.lit(1)).alias("calls")]
    for c in ([context_col] if context_col else []) + list(extra_last):
        aggs.append(F.max_by(F.col(c), last).alias(f"last_{c}"))
    return sessions.groupBy(key, "session_no", "session_id").agg(*aggs)


def resolve_session_id(events: DataFrame, key: str, ts: str = "ts", override_col: str = "override_id",
                       thread_col: str = "thread_id", **kw) -> DataFrame:
    """``coalesce(override, thread id, gap session)`` with a ``source`` column
    ('env', 'thread', 'gap').  Events with an explicit id are not sessionized."""
    explicit = F.col(override_col).isNotNull() | F.col(thread_col).isNotNull()
    gap = sessionize(events.where(~explicit), key, ts, **kw)
    gap = gap.withColumn("source", F.lit("gap")).drop("is_new", "session_no", "session_start")
    fixed = (events.where(explicit)
             .withColumns({"session_id": F.coalesce(F.col(override_col), F.col(thread_col)),
                           "source": F.when(F.col(override_col).isNotNull(), "env").otherwise("thread")}))
    return gap.unionByName(fixed)
