"""A replayed stream gives the batch answers on a small fixture."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from linesift.operators.sessions import sessionize
import pytest

from linesift.streaming.runner import drain, fold_sink, fresh_folder, read_sink, run_into
from linesift.streaming.sessions import open_sessions, running_sessions, stream_assign_sessions, stream_savings, stream_sessions


def _fixture(spark):
    rnd = random.Random(3)
    base = dt.datetime(2026, 1, 1)
    rows, eid = [], 0
    for user in range(12):
        t = base
        for _ in range(rnd.randint(1, 25)):
            t = t + dt.timedelta(seconds=rnd.choice([30, 900, 1800, 1801, 5000]))
            rows.append((eid, user, t, rnd.choice(["a", "b"])))
            eid += 1
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, ctx string")
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    df.write.mode("overwrite").parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_online_sessions_equal_batch(spark):
    batch, stream = _fixture(spark)
    online = drain(spark, stream_assign_sessions(stream, "user_id", gap_seconds=1800, context_col="ctx",
                                                 order_col="event_id"), "append", "t5")
    exp = sessionize(batch, "user_id", gap_seconds=1800, context_col="ctx", order_col="event_id")
    cols = ["event_id", "is_new", "session_no", "session_id"]
    assert sorted(online.select(*cols).collect()) == sorted(exp.select(*cols).collect())


def test_session_windows_closed(spark):
    batch, stream = _fixture(spark)
    got = drain(spark, stream_sessions(stream, "user_id", gap_seconds=1800, watermark="0 seconds"), "append", "t4")
    exp = (sessionize(batch, "user_id", gap_seconds=1800)
           .groupBy("user_id", "session_no").agg(F.min("ts").alias("s"), F.max("ts").alias("e"),
                                                 F.count(F.lit(1)).alias("n")))
    max_ts = batch.agg(F.max("ts")).first()[0]
    want = {(r.user_id, r.s, r.n) for r in exp.collect() if r.e + dt.timedelta(seconds=1800) <= max_ts}
    have = {(r.user_id, r.session_start, r.events) for r in got.collect()}
    assert have == want and len(want) > 0


def test_online_sessions_over_many_batches(spark):
    """24 micro-batches, keys that are silent for many of them, missing users and
    times, context changes, with and without the gap rule: as in batch."""
    rnd = random.Random(9)
    base = dt.datetime(2026, 1, 1)
    path, rows = tempfile.mkdtemp(prefix="linesift-stream-"), []
    for batch in range(24):
        part = []
        for user in (0, 1, 2, 3, None):
            if user == 1 and batch not in (0, 20) or user == 2 and batch % 5:
                continue
            for _ in range(rnd.randint(1, 4)):
                t = base + dt.timedelta(hours=batch, seconds=rnd.randrange(3600))
                part.append((len(rows) + len(part), user, t if rnd.random() < 0.95 else None, rnd.choice(["a", "b", None])))
        rows += part
        schema = "event_id long, user_id long, ts timestamp, ctx string"
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, schema)
    cols = ["event_id", "is_new", "session_no", "session_start", "session_id"]
    for gap in (1800, 0):
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
        online = drain(spark, stream_assign_sessions(stream, "user_id", gap_seconds=gap, context_col="ctx", order_col="event_id"),
                       "append", "many")
        exp = sessionize(whole, "user_id", gap_seconds=gap, context_col="ctx", order_col="event_id")
        assert sorted(map(str, online.select(*cols).collect())) == sorted(map(str, exp.select(*cols).collect()))


def test_savings_stream_keeps_calls_without_time(spark):
    from linesift.operators.usage import with_effective
    from linesift.sources.logs import read_invocations, stream_invocations
    from linesift.streaming.sessions import stream_savings
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    for k, lines in enumerate((['{"command":"a","stdout_lines":3,"timestamp":"2026-01-09T00:00:00+00:00"}', "{bad json"],
                               ['{"command":"a","stdout_lines":4,"timestamp":"2026-01-01T00:00:00+00:00"}', '\t{"command":"a","stdout_lines":5.0}'],
                               ['{"command":"b","stdout_lines":"x"}', "[]", ""])):
        with open(f"{path}/{k}.jsonl", "w") as f:
            f.write("\n".join(lines))
    got = drain(spark, stream_savings(stream_invocations(spark, path, 1)), "update", "w6", latest_by=["day", "command"])
    have = {(r.day, r.command): (r.calls, r.raw_lines) for r in got.collect()}
    assert have == {("2026-01-09", "a"): (1, 3), ("2026-01-01", "a"): (1, 4), ("unknown", "a"): (1, 5), ("unknown", "b"): (1, 0)}
    assert with_effective(read_invocations(spark, path)).count() == 4


def _write(spark, path, batches, schema):
    """One file, so one micro-batch, for each of ``batches``."""
    import time
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


BASE = dt.datetime(2026, 1, 1)
EVENT = "event_id long, user_id long, ts timestamp, ctx string"


def _at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def test_closed_and_open_sessions_are_the_batch_result(spark):
    """Append mode over 12 batches: closed sessions, open ones from the state, events
    behind the watermark dropped and counted, and a state that does not grow."""
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    batches = [[(b * 10 + u, u, _at(60 * b + u), "a") for u in (b, b, 100)] + [(-b, None, _at(60 * b), "a"), (-100 - b, 5, None, "a")]
               for b in range(12)]
    late = [(999, 77, _at(1), "a")]
    stream = _write(spark, path, [*batches, late], EVENT)
    s = stream_sessions(stream, "user_id", gap_seconds=1800, watermark="0 seconds")
    run = run_into(spark, s, fresh_folder(spark, "w4"))
    closed, still = read_sink(spark, run.folder, s.schema), open_sessions(spark, run.checkpoint, "user_id")
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT)
    exp = sessionize(whole.where("ts IS NOT NULL"), "user_id", gap_seconds=1800, order_col="event_id") \
        .groupBy("user_id", "session_no").agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count(F.lit(1)).alias("n"))
    want = {(r.user_id, r.s, r.e, r.n) for r in exp.collect()}
    got = [(r.user_id, r.first_ts, r.last_ts, r.events) for r in closed.unionByName(still).collect()]
    assert len(got) == len(want) and set(got) == want
    assert 0 < still.count() < len(want) / 2 and run.dropped >= 1
    assert max(run.state_rows) <= 8                              # three users a batch and the missing one, of two batches


def test_state_of_silent_keys_leaves(spark):
    """The running session goes once the watermark has passed its gap; the count of
    sessions stays, so a key that comes back is numbered on."""
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    batches = [[(1, 1, _at(0), "a"), (2, 2, _at(0), "a")], [(3, 2, _at(100), "a")], [(4, 2, _at(200), "a")], [(5, 2, _at(201), "a")],
               [(6, 1, _at(300), "b")], [(7, 2, _at(301), "a")]]
    stream = _write(spark, path, batches, EVENT)
    s = stream_assign_sessions(stream, "user_id", gap_seconds=1800, context_col="ctx", order_col="event_id", watermark="0 seconds")
    run = run_into(spark, s, fresh_folder(spark, "w5"))
    got = {r.event_id: (r.is_new, r.session_no, r.late) for r in read_sink(spark, run.folder, s.schema).collect()}
    assert got == {1: (True, 1, False), 2: (True, 1, False), 3: (True, 2, False), 4: (True, 3, False), 5: (False, 3, False),
                   6: (True, 2, False), 7: (True, 4, False)}
    held = spark.read.format("statestore").option("stateVarName", "running").load(run.checkpoint)
    assert {r[0] for r in held.select("key.user_id").collect()} <= {1, 2}
    whole = spark.createDataFrame([r for b in batches[:4] for r in b], EVENT)
    # after the first four batches, nothing of user 1 is left but its count
    again = tempfile.mkdtemp(prefix="linesift-stream-")
    first = stream_assign_sessions(_write(spark, again, [*batches[:4], [(8, 2, _at(202), "a")]], EVENT), "user_id", gap_seconds=1800, watermark="0 seconds")
    run = run_into(spark, first, fresh_folder(spark, "w5"))
    running = spark.read.format("statestore").option("stateVarName", "running").load(run.checkpoint).select("key.user_id").collect()
    count = spark.read.format("statestore").option("stateVarName", "count").load(run.checkpoint).select("key.user_id", "value.sessions").collect()
    assert [r[0] for r in running] == [2] and {tuple(r) for r in count} == {(1, 1), (2, 3)} and whole.count() == 5


def test_late_and_unordered_events(spark):
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    batches = [[(1, 1, _at(0), "a"), (2, 1, _at(50), "a")],
               [(3, 1, _at(60), "a"), (4, 1, _at(55), "b"), (5, 1, None, "a")],      # unordered within a batch: sorted
               [(6, 1, _at(57), "b")],                                               # inside the running session
               [(7, 1, _at(20), "a")],                                               # before its start
               [(8, 2, _at(400), "a")], [(9, 2, _at(401), "a")],
               [(10, 1, _at(70), "b"), (11, 3, _at(1), "a")]]                        # session closed long ago; first of its key
    s = stream_assign_sessions(_write(spark, path, batches, EVENT), "user_id", gap_seconds=1800, context_col="ctx", order_col="event_id",
                               watermark="0 seconds")
    got = {r.event_id: (r.is_new, r.session_no, r.late) for r in drain(spark, s, "append", "late").collect()}
    assert got == {1: (True, 1, False), 2: (True, 2, False), 4: (True, 3, False), 3: (True, 4, False), 5: (False, None, False),
                   6: (False, None, True), 7: (False, None, True), 8: (True, 1, False), 9: (False, 1, False),
                   10: (False, None, True), 11: (True, 1, False)}


def test_stream_goes_on_after_the_batch_table(spark):
    """Initial state from a batch table: history in batch, the rest online, equal to
    all of it in batch."""
    rnd, rows = random.Random(5), []
    for user in (0, 1, 2, None):
        t = 0
        for _ in range(40):
            t += rnd.choice([1, 10, 30, 31, 90])
            rows.append((len(rows), user, _at(t), rnd.choice(["a", "b", None])))
    split = _at(700)
    schema = "event_id long, user_id long, ts timestamp, ctx string"
    past = spark.createDataFrame([r for r in rows if r[2] < split], schema)
    rest = sorted((r for r in rows if r[2] >= split), key=lambda r: r[2])
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    stream = _write(spark, path, [rest[k:k + 20] for k in range(0, len(rest), 20)], schema)
    args = dict(gap_seconds=1800, context_col="ctx", order_col="event_id")
    state = running_sessions(sessionize(past, "user_id", **args), "user_id", context_col="ctx", order_col="event_id")
    online = drain(spark, stream_assign_sessions(stream, "user_id", initial=state, **args), "append", "go-on")
    cols = ["event_id", "is_new", "session_no", "session_start", "session_id"]
    exp = sessionize(spark.createDataFrame(rows, schema), "user_id", **args).where(F.col("ts") >= F.lit(split))
    assert rest and sorted(map(str, online.select(*cols).collect())) == sorted(map(str, exp.select(*cols).collect()))


def test_killed_sink_goes_on(spark):
    """Killed between a batch's rows and its commit, and started again: the rows of
    that batch count once; folding keeps the result."""
    schema = "ts timestamp, session_id string, command string, stdout_lines long, stdout_bytes long, compressed_lines long, full boolean"
    path = tempfile.mkdtemp(prefix="linesift-stream-")
    batches = [[(_at(1440 * (b % 3)), "s", f"c{k % 2}", 10 + k, 100, 5, False) for k in range(b + 1)] for b in range(6)]
    stream = _write(spark, path, batches, schema)
    s = stream_savings(stream)
    folder, keys = fresh_folder(spark, "killed"), ["day", "command"]

    def kill(batch):
        if batch == 3:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run_into(spark, s, folder, "update", before_commit=kill)
    seen = read_sink(spark, folder, s.schema, "update", keys)
    assert sum(r.calls for r in seen.collect()) == 1 + 2 + 3                          # batch 3 has no commit
    run_into(spark, s, folder, "update")
    want = sorted(map(str, stream_savings(spark.createDataFrame([r for b in batches for r in b], schema)).collect()))
    assert sorted(map(str, read_sink(spark, folder, s.schema, "update", keys).collect())) == want
    fold_sink(spark, folder, s.schema, keys)
    assert sorted(map(str, read_sink(spark, folder, s.schema, "update", keys).collect())) == want
    more = [(_at(0), "s", "c0", 7, 70, None, False)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(path)
    run_into(spark, s, folder, "update")
    want = sorted(map(str, stream_savings(spark.createDataFrame([r for b in [*batches, more] for r in b], schema)).collect()))
    assert sorted(map(str, read_sink(spark, folder, s.schema, "update", keys).collect())) == want
    assert run_into(spark, s, folder, "update").progress is not None                  # nothing new: nothing changes
    assert sorted(map(str, read_sink(spark, folder, s.schema, "update", keys).collect())) == want
