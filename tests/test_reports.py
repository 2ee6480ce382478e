"""Usage reports (A1-A11, E3, S3), trials (X5-X8) and checklists (C1-C3): golden cases."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from linesift.operators import trials as X
from linesift.operators import usage as U
from linesift.operators.checklist import checklist_phases, checklist_status

INV = ("ts timestamp, session_id string, command string, args array<string>, stdout_bytes long, "
       "stdout_lines long, compressed_lines long, full boolean")


def inv(spark, rows):
    return spark.createDataFrame(rows, INV)


def test_savings_golden(spark):
    t = dt.datetime(2026, 1, 1, 10)
    df = inv(spark, [(t, "a", "cat", ["f"], 1000, 100, 10, None),
                     (t, "a", "rg", ["x"], 200, 20, 5, None),
                     (t, "a", "git", ["log"], 300, 30, None, True)])
    s = U.savings(df).first()
    assert (s.raw_lines, s.effective_lines, s.saved_lines) == (150, 45, 105)
    assert s.line_savings_pct == pytest.approx(70.0)
    assert (s.raw_bytes, s.effective_bytes_estimate) == (1500, pytest.approx(450.0))
    assert s.saved_tokens_estimate == pytest.approx(262.5)
    assert (s.compressed_calls, s.full_calls) == (2, 1)
    assert [r.command for r in U.savings_by_command(df).collect()] == ["cat", "rg", "git"]
    roll = {r.command: r for r in U.savings_with_total(df).collect()}
    assert roll[None].is_total and roll[None].saved_lines == 105


def test_nothing_compacted(spark):
    df = inv(spark, [(None, "a", "ls", [], 0, 0, None, None), (None, "a", "ls", [], 100, 10, None, None)])
    s = U.savings(df).first()
    assert (s.effective_lines, s.effective_bytes_estimate) == (10, pytest.approx(100.0))


def test_by_session_and_time_filter(spark):
    d = dt.datetime
    df = inv(spark, [(d(2026, 1, 1, 9), "s1", "cat", [], 100, 10, 5, None),
                     (d(2026, 1, 1, 12), "s2", "cat", [], 200, 20, 10, None),
                     (d(2026, 1, 1, 15), "s2", "cat", [], 200, 20, 10, None)])
    rows = {r.key: r for r in U.savings_by_session(df).collect()}
    assert rows["s1"].saved_tokens_estimate == pytest.approx(12.5)
    assert rows["s2"].saved_tokens_estimate == pytest.approx(50.0)
    w = U.filter_time(df, "2026-01-01 10:00:00", "2026-01-01 12:00:00").collect()
    assert [r.ts.hour for r in w] == [12]


def test_usage_tables(spark):
    t = dt.datetime(2026, 1, 1)
    df = inv(spark, [(t, "a", "cat", ["x"], 10, 1, None, True), (t, "a", "cat", ["x"], 10, 1, None, None),
                     (t, "b", "rg", ["y"], 5, 4, 2, None)])
    assert [(r.command, r.calls) for r in U.spend_by_command(df).collect()] == [("cat", 2), ("rg", 1)]
    assert [(r.command, r.n) for r in U.repeated_invocations(df).collect()] == [("cat", 2)]
    assert [(r.session_id, r.full_calls, r.total_calls) for r in U.bypass_by_session(df).collect()] == [("a", 1, 2)]
    bc = {r.command: r for r in U.bypass_by_command(df).collect()}
    assert bc["rg"].compacted_calls == 1 and bc["rg"].lines_saved == 2 and bc["cat"].full_rate == 0.5
    assert U.groups_remaining(U.savings_by_session(df), 1).first().more == 1


def test_token_estimate(spark):
    from linesift.functions.text import token_estimate
    r = spark.createDataFrame([(5,), (0,)], "b long").select(token_estimate(F.col("b")).alias("t")).collect()
    assert [x.t for x in r] == [2, 0]


def _runs(spark, triples):
    rows = []
    for trial, (b, t) in enumerate(triples, start=1):
        rows.append((trial, "baseline", b[0], b[1], b[2], 0))
        if t is not None:
            rows.append((trial, "treatment", t[0], t[1], t[2], 0))
    return spark.createDataFrame(rows, "trial int, variant string, input_tokens long, output_tokens long, "
                                       "command_count long, returncode int")


def test_trial_deltas_and_aggregate(spark):
    runs = _runs(spark, [((1000, 1000, 1000), (635, 709, 616)),
                         ((1000, 1000, 1000), (970, 1433, 1162)),
                         ((1000, 1000, 1000), (991, 1024, 968))])
    d = X.trial_deltas(runs)
    first = {r.metric: r.delta_pct for r in d.where("trial = 1").collect()}
    assert first["input_tokens"] == pytest.approx(-36.5)
    agg = {r.metric: r for r in X.aggregate_deltas(d).collect()}
    assert agg["input_tokens"].mean_pct == pytest.approx(-13.4667, abs=1e-4)
    assert agg["input_tokens"].median_pct == pytest.approx(-3.0)
    assert agg["input_tokens"].stdev_pct_points == pytest.approx(19.9751, abs=1e-4)
    assert agg["output_tokens"].mean_pct == pytest.approx(5.5333, abs=1e-4)
    assert agg["output_tokens"].stdev_pct_points == pytest.approx(36.3016, abs=1e-4)
    assert agg["command_count"].stdev_pct_points == pytest.approx(27.6784, abs=1e-4)
    orders = {r.trial: r.order for r in X.with_order(d).collect()}
    assert orders[1] == "baseline-first" and orders[2] == "treatment-first"


def test_group_medians_equal_sorted_ones(spark):
    rnd = random.Random(6)
    groups = {"even": [rnd.gauss(0, 9) for _ in range(3000)], "odd": [rnd.gauss(0, 9) for _ in range(3001)],
              "one value": [2.5] * 500, "mostly one": [7.0] * 400 + [rnd.random() for _ in range(300)],
              "two halves": [1.0] * 50 + [9.0] * 50, "single": [-4.0], "none": [None, None], None: [1.0, None, 3.0, 8.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    for parts in (2, 16, 256):
        got = {r.g: r.median for r in X.group_medians(df, ["g"], "v", parts).collect()}
        assert got == {g: pytest.approx(statistics.median([v for v in vs if v is not None]))
                       for g, vs in groups.items() if g != "none"}
    assert X.group_medians(df.limit(0), ["g"], "v").count() == 0


def test_trial_aggregate_buffers_no_values(spark):
    d = X.trial_deltas(_runs(spark, [((10, 10, 10), (9, 12, 10))] * 3))
    plan = X.aggregate_deltas(d)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan and "collect_list" not in plan
    assert {r["count"] for r in X.aggregate_deltas(d).collect()} == {3}


def test_trial_missing_variant_and_zero_baseline(spark):
    runs = _runs(spark, [((0, 10, 10), (5, 10, 10)), ((10, 10, 10), None)])
    d = {(r.trial, r.metric): r.delta_pct for r in X.trial_deltas(runs).collect()}
    assert d[(1, "input_tokens")] is None and d[(2, "input_tokens")] is None
    agg = {r.metric: r for r in X.aggregate_deltas(X.trial_deltas(runs)).collect()}
    assert agg["input_tokens"]["count"] == 0 and agg["input_tokens"].stdev_pct_points is None
    assert agg["output_tokens"]["count"] == 1 and agg["output_tokens"].stdev_pct_points == 0.0


CHECKLIST = """# Tasks

## Phase 1: Setup
- [x] Install tools
- [ ] Write config

## Notes
- [ ] still phase 1

## Phase 2: Build
- [ ] Compile
- [X] Link
-  [ ] not a task
- [ ]
"""


def test_checklist(spark):
    docs = spark.createDataFrame([(1, CHECKLIST), (2, "## Phase 1\n- [x] a\n- [X] b\n"), (3, "no tasks")],
                                 "doc_id long, text string")
    st = {r.doc_id: r for r in checklist_status(docs).collect()}
    assert (st[1].next_task_title, st[1].next_task_line, st[1].next_task_phase_index) == ("Write config", 5, 1)
    assert st[1].current_phase.pending_tasks == 2 and not st[1].all_tasks_done
    assert st[2].all_tasks_done and st[2].next_task_title is None and st[2].current_phase is None
    assert st[3].all_tasks_done and st[3].phase_count == 0
    ph = {(r.doc_id, r.phase_index): r for r in checklist_phases(docs).collect()}
    assert (ph[(1, 1)].total_tasks, ph[(1, 1)].completed_tasks) == (3, 1)
    assert (ph[(1, 2)].total_tasks, ph[(1, 2)].completed_tasks, ph[(1, 2)].next_task) == (2, 1, "Compile")
    assert ph[(2, 1)].completed


def test_report_sinks(spark):
    from linesift.sources.reports import aggregate_report_rows, trial_report_json, trial_report_rows
    runs = _runs(spark, [((1000, 1000, 1000), (635, 709, 616)), ((1000, 0, 1000), (970, 5, 1162))])
    d = X.with_order(X.trial_deltas(runs))
    rows = {r.trial: r.row for r in trial_report_rows(d).collect()}
    assert rows[1] == "| 1 | baseline-first | 1000 | 635 | -36.5% | 1000 | 709 | -29.1% | 1000 | 616 | -38.4% |"
    assert "| 0 | 5 | n/a |" in rows[2]
    agg = {r.metric: r.row for r in aggregate_report_rows(X.aggregate_deltas(d)).collect()}
    assert agg["output_tokens"] == "| Output Tokens | -29.1% | -29.1% | 0.0pp |"
    docs = trial_report_json(d, X.aggregate_deltas(d)).collect()
    trial_docs = sorted(r.json for r in docs if r.kind == "trial")
    assert len(trial_docs) == 2 and '"order":"baseline-first"' in trial_docs[0]
    assert '"order":"treatment-first"' in trial_docs[1]
    assert ['"aggregate"' in r.json and '"trial_count":2' in r.json for r in docs if r.kind == "report"] == [True]


def test_report_as_one_document(spark):
    """All trials in order, the results once more for a lone trial, no silent bound."""
    import json

    import pytest
    from pyspark.sql import functions as F

    from linesift.operators import trials as X
    from linesift.sources.reports import trial_report_document, trial_report_lines
    rows = [(t, v, 100 + t, 10, 5, 0) for t in (2, 1, 3) for v in ("baseline", "treatment")]
    runs = spark.createDataFrame(rows, "trial int, variant string, input_tokens long, output_tokens long, command_count long, returncode int")

    def document(r, **kw):
        d = X.with_order(X.trial_deltas(r))
        return d, trial_report_document(d, X.aggregate_deltas(d), r, repo="r", base="b", generated="now", **kw)

    d, whole = document(runs)
    doc = json.loads(whole.first().json)
    assert whole.count() == 1 and [t["index"] for t in doc["trials"]] == [1, 2, 3] and doc["trial_count"] == 3
    assert (doc["repo"], doc["base"], doc["generated_at"]) == ("r", "b", "now") and "results" not in doc
    assert [x["name"] for x in doc["trials"][0]["results"]] == ["baseline", "treatment"]
    one = json.loads(document(runs.where("trial = 2"))[1].first().json)
    assert one["results"] == one["trials"][0]["results"] and len(one["results"]) == 2
    with pytest.raises(ValueError, match="trial_report_json"):
        document(runs, most_trials=2)
    head = [r.line for r in trial_report_lines(d, X.aggregate_deltas(d), repo="r", base="b", generated="now").where("section = 0").orderBy("position").collect()]
    assert head == ["# Trial Results", "", "**Repo:** `r`  ", "**Base:** `b`  ", "**Trials:** 3  ", "**Generated:** now", ""]
    assert X.trial_deltas(runs).where(F.col("trial").isNull()).count() == 0
