"""Online sessionization (W4, W5) and running savings (W6) in Structured Streaming.

* W4 ``stream_sessions``: ``session_window`` per key behind a watermark; two
  events exactly one gap apart stay in one session (Spark's session window,
  matching the strict ``>`` of the batch rule).  No context rule.  In append mode
  a session is written once the watermark has passed its end; its state goes
  then.  ``open_sessions`` reads the sessions that a checkpoint still holds open
  from its state store, so closed and open ones together are the batch result.
  Events behind the watermark that fit no open session are dropped and counted
  (``numRowsDroppedByWatermark``); events without a time are in no session.
* W5 ``stream_assign_sessions``: the full batch rule (gap and context change)
  decided online per key with ``transformWithState``.  A key has two values: the
  running session (last time, context, start), which an event-time timer clears
  once the watermark has passed its gap, and the number of its sessions, which
  stays so that numbering continues.  Both can start from the batch table
  (``running_sessions``).  Every event is emitted with its session (append).
* W6 ``stream_savings``: per (day, command) savings sums, update mode.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.usage import day_label
from ..operators.sessions import DEFAULT_GAP_SECONDS, session_id_expr
from ..operators.usage import with_effective

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_sessions(events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS,
                    watermark: str = "1 hour") -> DataFrame:
    """Session windows per key: start, end (last event + gap), events."""
    gap = f"{int(gap_seconds)} seconds"
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", watermark)
    return (e.groupBy(F.col(key), F.session_window("_t", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("_t").alias("first_ts"), F.max("_t").alias("last_ts"))
            .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                    "events", "first_ts", "last_ts"))


def open_sessions(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The sessions that the state of a ``stream_sessions`` query holds after its
    last batch, in the columns of its result."""
    state = spark.read.format("statestore").load(checkpoint)
    count, least, most = [f.name for f in state.schema["value"].dataType.fields][-3:]       # in the order of its aggregates
    v = F.col("value")
    return state.select(v[key].alias(key), v["session_window"]["start"].alias("session_start"), v["session_window"]["end"].alias("session_end"),
                        v[count].alias("events"), v[least].alias("first_ts"), v[most].alias("last_ts"))


class SessionAssigner(StatefulProcessor):
    """W5 for one key and micro-batch.  In time order, ties by ``order``:

    * an event at or after the last one opens a session by the batch rule;
    * an earlier one that is not before the running session's start belongs to it
      and changes nothing;
    * one before that start, or behind the watermark when no session runs, is late:
      it has no session;
    * an event without a time has none either.
    """

    def __init__(self, gap_us: int, key: str, order: str | None, columns: list[str]):
        self.gap_us, self.key, self.order, self.columns = gap_us, key, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "last_us long, ctx string, start_us long")
        self.count = handle.getValueState("count", "sessions long")

    def _await_end(self, last_us: int) -> None:
        if self.gap_us > 0:
            self.handle.registerTimer((last_us + self.gap_us) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        state = self.running.get() if self.running.exists() else None
        number = self.count.get()[0] if self.count.exists() else 0
        known, before, numbered = state is not None, state, number
        timed = []
        for r in rows:
            if r["s_us"] is None:
                yield self._out(r, False, None, None, False)
            else:
                timed.append(r)
        timed.sort(key=lambda r: (r["s_us"], r["s_order"] is not None, r["s_order"] if r["s_order"] is not None else 0))
        for r in timed:
            us, ctx = r["s_us"], r["s_ctx"]
            late = us < state[2] if state else number > 0 and us < watermark_us
            new = False
            if state and us < state[0] or late:
                pass
            elif state and not (0 < self.gap_us < us - state[0]) and (state[1] is None or state[1] == ctx):
                state = (us, ctx, state[2])
            else:
                new, number, state = True, number + 1, (us, ctx, us)
            yield self._out(r, new, None if late else number, None if late else state[2], late)
        if state != before:
            self.running.update(state)
            if not known:
                self._await_end(state[0])
        if number != numbered:
            self.count.update((number,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.running.exists():
            last_us = self.running.get()[0]
            if (last_us + self.gap_us) // 1000 < timerValues.getCurrentWatermarkInMs():
                self.running.clear()
            else:                                                # events came since the timer was set
                self._await_end(last_us)
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.count.update((initialState["sessions"],))
        if initialState["last_us"] is not None:
            self.running.update((initialState["last_us"], initialState["ctx"], initialState["start_us"]))
            self._await_end(initialState["last_us"])

    def close(self) -> None:
        pass

    def _out(self, r: Row, new: bool, number: int | None, start_us: int | None, late: bool) -> Row:
        return Row(**{c: r[c] for c in self.columns}, is_new=new, session_no=number, s_start=start_us, late=late)


def running_sessions(sessions: DataFrame, key: str, ts: str = "ts", context_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """The state from which W5 goes on after a batch ``sessionize``: per key the
    number of sessions, and time, context and session start of its last event."""
    last = F.max(F.struct(F.col(ts).alias("t"), *([F.col(order_col).alias("o")] if order_col else []),
                          (F.col(context_col) if context_col else F.lit(None).cast("string")).alias("ctx"), F.col("session_start").alias("s"))).alias("x")
    agg = sessions.where(F.col("session_no").isNotNull()).groupBy(key).agg(F.max("session_no").alias("sessions"), last)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))             # noqa: E731
    return agg.select(key, "sessions", micros("x.t").alias("last_us"), F.col("x.ctx").alias("ctx"), micros("x.s").alias("start_us"))


def stream_assign_sessions(events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS,
                           context_col: str | None = None, order_col: str | None = None, watermark: str = "1 hour",
                           initial: DataFrame | None = None) -> DataFrame:
    """Every event with ``is_new``, ``session_no``, ``session_start``, ``session_id``
    (those of the batch ``sessionize`` where events of a key come in time order) and
    ``late``.  ``initial``: ``running_sessions`` of the events before the stream's.
    State lives in RocksDB: this sets the session's state store provider where it is
    not set yet.  A key's events of one micro-batch are sorted in memory; bound them
    by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``."""
    conf = events.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    names = events.columns
    # the watermark drives the timers; without its column nothing is dropped as late
    e = events.withColumn("s_time", F.col(ts).cast("timestamp")).withWatermark("s_time", watermark)
    e = e.select(*names, F.unix_micros("s_time").alias("s_us"), (F.col(context_col) if context_col else F.lit(None)).cast("string").alias("s_ctx"),
                 (F.col(order_col) if order_col else F.lit(None).cast("long")).alias("s_order"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    res = e.groupBy(key).transformWithState(
        SessionAssigner(int(gap_seconds) * 1_000_000, key, order_col, names),
        schema + ", is_new boolean, session_no long, s_start long, late boolean", "append", "eventTime",
        initialState=None if initial is None else initial.groupBy(key))
    start = F.timestamp_micros("s_start")
    return res.withColumn("session_start", start).withColumn("session_id", F.when(
        F.col("session_no").isNotNull(), session_id_expr(F.col(key), F.col("session_no"), start))).drop("s_start")


def stream_savings(stream: DataFrame) -> DataFrame:
    """Running raw/effective lines and bytes, calls and bypasses per UTC day
    and command (update mode: each trigger emits the groups it changed).  Late
    calls count, and calls without a time are the day ``unknown``, as in the batch
    report; the state is one row per day and command."""
    return (with_effective(stream).groupBy(day_label(F.col("ts")).alias("day"), "command")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("stdout_lines").alias("raw_lines"),
                 F.sum("eff_lines").alias("effective_lines"), F.sum("stdout_bytes").alias("raw_bytes"),
                 F.sum("eff_bytes").alias("effective_bytes_estimate"), F.count_if("full").alias("full_calls")))
