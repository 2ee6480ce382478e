"""Sources (S1-S3, S6, S7), sessionization (W1-W3) and the driver contract."""

import datetime as dt
import json
import os
import random
import tempfile

from linesift.operators.sessions import resolve_session_id, session_facts, sessionize
from linesift.sources.logs import read_cases, read_documents, read_invocations, write_invocations


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_read_invocations_lenient(spark):
    d = tempfile.mkdtemp(prefix="linesift-test-")
    good = {"timestamp": "2026-01-01T12:00:00.123456+00:00", "session_id": "s1", "command": "cat",
            "args": ["a"], "stdout_bytes": 10, "stdout_lines": 2, "compressed_lines": 1}
    early = dict(good, timestamp="2026-01-01T09:00:00+00:00")
    _write(os.path.join(d, "s1.jsonl"), "\n".join([json.dumps(good), "", "not json", "42", json.dumps(early)]) + "\n")
    _write(os.path.join(d, "s2.jsonl"), json.dumps(dict(good, session_id="s2", timestamp="bad")) + "\n")
    df = read_invocations(spark, d)
    assert df.count() == 3
    assert read_invocations(spark, d, session_id="s1").count() == 2
    win = read_invocations(spark, d, since="2026-01-01 10:00:00", until="2026-01-01 13:00:00").collect()
    assert [r.session_id for r in win] == ["s1"]
    # a missing timestamp fails "since" and passes "until"
    assert read_invocations(spark, d, until="2026-01-01 10:00:00").count() == 2


def test_session_by_stem_and_ids_as_written(spark):
    """The tool's layout chooses by file stem whatever ids stand inside; our sink's
    by the id inside the record; ids stay strings with all their characters."""
    from pyspark.sql import functions as F

    from linesift.sources.logs import to_log_records, write_invocations
    d = tempfile.mkdtemp(prefix="linesift-test-")
    _write(os.path.join(d, "abc.jsonl"), '{"command":"x"}\n{"command":"y","session_id":"other"}\n\t{"command":"z","args":"no list","stdout_lines":3.0}\n{bad')
    _write(os.path.join(d, "007.jsonl"), '{"command":"x","session_id":"007"}\n')
    got = read_invocations(spark, d, session_id="abc").collect()
    assert sorted((r.command, r.session_id, r.args, r.stdout_lines) for r in got) == [
        ("x", None, None, None), ("y", "other", None, None), ("z", None, None, 3)]
    assert [r.session_id for r in read_invocations(spark, d, session_id="007").collect()] == ["007"]
    ids = ["007", "42", "a/b:c", "x=y %2F", None]
    facts = spark.createDataFrame([(i, "cat", 10) for i in ids], "session_id string, command string, stdout_bytes long") \
        .withColumn("ts", F.when(F.col("session_id") != "42", F.lit("2026-01-01 10:00:00").cast("timestamp"))) \
        .withColumn("full", F.lit(False))
    out = os.path.join(d, "sink")
    write_invocations(to_log_records(facts), out)
    assert sorted(r.session_id or "" for r in read_invocations(spark, out).collect()) == sorted(i or "" for i in ids)
    for i in ids[:4]:
        assert read_invocations(spark, out, session_id=i).count() == 1
    assert read_invocations(spark, out, since="2026-01-01 09:00:00").count() == 3
    assert read_invocations(spark, out, until="2026-01-01 09:00:00").count() == 2          # those without a time


def test_agent_events_skip_bad_lines(spark):
    from linesift.sources.logs import read_message_events, read_thread_events
    d = tempfile.mkdtemp(prefix="linesift-test-")
    _write(os.path.join(d, "run-1.jsonl"), '{"type":"a","thread_id":"t"}\n{bad\n\n[1]\n {"type":"b","usage":{"input_tokens":"many"}}\n')
    for read in (read_thread_events, read_message_events):
        got = read(spark, d).orderBy("line_no").collect()
        assert [(r.run_id, r.line_no, r.type) for r in got] == [("run-1", 0, "a"), ("run-1", 4, "b")]


def test_rows_without_key_or_time_stay(spark):
    from linesift.operators.runs import collapse_runs
    from linesift.operators.scan import segmented_scan
    t = dt.datetime(2026, 1, 1)
    ev = spark.createDataFrame([(None, t, 1), (None, t + dt.timedelta(seconds=5), 2), (1, None, 3), (1, t, 4), (None, None, 5)],
                               "k long, ts timestamp, i long")
    got = {r.i: (r.session_no, r.session_id is not None) for r in sessionize(ev, "k", order_col="i").collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (None, False), 4: (1, True), 5: (None, False)}
    same = spark.createDataFrame([(1, t, 1, "a"), (1, t, 2, "b")], "k long, ts timestamp, i long, c string")
    two = sessionize(same, "k", context_col="c", order_col="i").collect()
    assert len({r.session_id for r in two}) == 2            # two sessions that start at one instant
    lines = spark.createDataFrame([(None, i, "x\n") for i in range(6)] + [(1, 0, "y\n")], "output_id long, line_no int, line string")
    out = {(r.output_id, r.seq): r.line for r in collapse_runs(lines).collect()}
    assert out == {(None, 0): "x\n", (None, 1): "# ... repeated 6 times\n", (1, 0): "y\n"}
    d = spark.createDataFrame([(None, 1), (None, 2), ("", 1), ("a", None), ("a", 7)], "k string, p long")
    sums = sorted((str(r.k), str(r.p), r.n) for r in segmented_scan(d, ["k"], "p", chunk_rows=2, running_sum={"n": F_ONE()}).collect())
    assert sums == [("", "1", 1), ("None", "1", 1), ("None", "2", 2), ("a", "7", 2), ("a", "None", 1)]


def F_ONE():
    from pyspark.sql import functions as F
    return F.lit(1)


def test_read_cases_and_documents(spark):
    d = tempfile.mkdtemp(prefix="linesift-test-")
    _write(os.path.join(d, "cases.jsonl"),
           '{"command": "rg", "args": ["x"]}\n\nbad\n{"command": ""}\n{"command": "ls"}\n')
    cases = read_cases(spark, d).orderBy("case_id").collect()
    assert [(c.command, list(c.args)) for c in cases] == [("rg", ["x"]), ("ls", [])]
    _write(os.path.join(d, "tasks.md"), "## Phase 1\n- [ ] a\n")
    docs = read_documents(spark, os.path.join(d, "tasks.md")).collect()
    assert docs[0].text.startswith("## Phase 1")


def _model(events, gap, use_ctx):
    """Sequential statement of the rotation rule for one key."""
    out, last, ctx_last, no, start = [], None, None, 0, None
    for ts, ctx in events:
        new = (last is None or (gap > 0 and (ts - last).total_seconds() > gap)
               or (use_ctx and ctx_last is not None and ctx != ctx_last))
        if new:
            no, start = no + 1, ts
        out.append((new, no, start))
        last, ctx_last = ts, ctx
    return out


def test_sessionize_against_model(spark):
    rnd = random.Random(5)
    base = dt.datetime(2026, 1, 1)
    rows, by_key = [], {}
    for key in range(30):
        t = base
        for i in range(rnd.randint(1, 40)):
            t = t + dt.timedelta(seconds=rnd.choice([10, 600, 1800, 1801, 7200, 90000]))
            ctx = rnd.choice(["/a", "/b", None])
            rows.append((key, i, t, ctx))
            by_key.setdefault(key, []).append((t, ctx))
    df = spark.createDataFrame(rows, "k long, i long, ts timestamp, ctx string")
    for gap, use_ctx, bucket in ((1800, True, 3600), (1800, False, 86400), (0, True, 7200)):
        got = sessionize(df, "k", gap_seconds=gap, context_col="ctx" if use_ctx else None, order_col="i",
                         bucket_seconds=bucket).collect()
        res = {}
        for r in got:
            res.setdefault(r.k, []).append((r.i, r.is_new, r.session_no, r.session_start))
        for key, evs in by_key.items():
            exp = _model(evs, gap, use_ctx)
            have = [(n, s, st) for _, n, s, st in sorted(res[key])]
            assert have == exp, (gap, use_ctx, key)
    facts = session_facts(sessionize(df, "k", gap_seconds=1800), "k").collect()
    assert sum(f.calls for f in facts) == len(rows)


def test_resolve_session_id(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, t, "env-1", None), (1, t + dt.timedelta(seconds=5), None, "th"),
                                (1, t + dt.timedelta(seconds=9), None, None)],
                               "k long, ts timestamp, override_id string, thread_id string")
    r = {x.ts.second: (x.session_id, x.source) for x in resolve_session_id(df, "k").collect()}
    assert r[0] == ("env-1", "env") and r[5] == ("th", "thread") and r[9][1] == "gap"


def test_driver_contract(spark):
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "command" in df.columns and "saved_tokens_estimate" in df.columns


LINES = ['{"command":"a","stdout_lines":1}', '{"command":"b","command":"c"}', '{"command":"d","stdout_lines":NaN}', ' {"command":"e"} ',
         '{"command":"f","cwd":"NaN and \\"Infinity\\"","exit_code":-Infinity}', '{"command":"g"} x', '{"command":"h"} {"command":"i"}', '{"command":"j"}] }',
         '{"command":"k"}} ]', '{"command":"l","args":[{"x":1}]}', '{"command":"m","args":["}]"]}', "{'command':'n'}", '{"command":"o",}', "", "  ", "7", "[]",
         '["{}"]', '{"command":"p","cwd":"tab\tinside"}', "{}", '{"command":"q","stdout_lines":"3"}', '{"command":"r","x":{"a":1,"a":2}}',
         '{"command":"s"},{"command":"t"}', '{"command":"u","cwd":"\\u0001NaN"}']


def test_log_lines_as_python_reads_them(spark, tmp_path):
    import json
    (tmp_path / "one.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    want = []
    for line in LINES:
        try:
            record = json.loads(line.strip())
        except ValueError:
            continue
        if isinstance(record, dict):
            n = record.get("stdout_lines")
            want.append((record.get("command"), record.get("cwd"), int(n) if isinstance(n, (int, str)) else None))
    got = [(r.command, r.cwd, r.stdout_lines) for r in read_invocations(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sessions_of_any_name(spark, tmp_path):
    """The tool's layout reads one file, chosen by its stem; our sink's reads one
    bucket of each day."""
    names = ["a b", "x%y", "a+b", "[z]*", "{p,q}", "ü", "ab", "007", "7", "back\\slash", "q?", "x%20y", "x y"]
    for n in names:
        (tmp_path / f"{n}.jsonl").write_text('{"session_id":"inside","command":"c %s"}\n' % n.replace("\\", "/"), encoding="utf-8")
    (tmp_path / "ab.txt").write_text('{"command":"other"}\n')
    for n in names:
        df = read_invocations(spark, str(tmp_path), session_id=n)
        assert [r.command for r in df.collect()] == [f"c {n}".replace("\\", "/")], n
        assert len(df.inputFiles()) == 1
    assert read_invocations(spark, str(tmp_path), session_id="a/b").count() == 0
    assert read_invocations(spark, str(tmp_path), session_id="none").count() == 0
    ids = [*names, "a/b", "p:q", None]
    records = spark.createDataFrame([(f"2026-01-0{d + 1}T00:00:00+00:00", i, "c", d) for i in ids for d in range(3)],
                                    "timestamp string, session_id string, command string, stdout_lines long")
    for buckets in (None, 4):
        path = str(tmp_path / f"sink-{buckets}")
        write_invocations(records, path, buckets)
        for i in ids[:-1]:
            df = read_invocations(spark, path, session_id=i, since="2026-01-02 00:00:00")
            assert sorted((r.session_id, r.stdout_lines) for r in df.collect()) == [(i, 1), (i, 2)], i
        assert read_invocations(spark, path).count() == len(records.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
