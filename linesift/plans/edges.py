"""Registered round trips through the sinks and sources.

Derived logs are written with the sinks into a fresh folder under the
session's ``spark.checkpoint.dir`` (a shared folder on a cluster), read back
with the sources, and reduced with the usual operators; the results must equal
the direct computation, so the oracles are the same SQL.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import partial

from pyspark.sql import functions as F

from ..operators import trials as X
from ..operators.checklist import checklist_status
from ..operators.scan import cut_parts, free_shuffles
from ..operators.usage import savings_by_command, savings_by_session
from ..session import ensure_checkpoint_dir
from ..sources.logs import (read_cases, read_documents, read_invocations, read_message_events, read_thread_events,
                            to_log_records, write_events, write_invocations)
from ..sources.reports import trial_report_document, trial_report_json, trial_report_lines
from . import checklists, trials
from .catalog import ORACLE, register, rounded, sql_effective, sql_invocations, sql_savings_cols, with_ctes
from .inputs import event_invocations, table


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/linesift-{name}-{uuid.uuid4().hex}"


def _write_log(spark, sf_dir, buckets: int | None = None) -> str:
    path = scratch(spark, "log")
    inv = event_invocations(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    write_invocations(to_log_records(inv), path, buckets)
    return path


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns})


@register("log_roundtrip_savings", ORACLE["savings_by_session"])
def log_roundtrip_savings(spark, sf_dir):
    """K1 -> S1 -> A8: the log written per session and read back gives the same savings."""
    inv = read_invocations(spark, _write_log(spark, sf_dir))
    return _ntz(rounded(savings_by_session(inv)))


@register("log_session_slice", with_ctes(sql_invocations(), """
win AS (SELECT * FROM inv WHERE session_id = 's7'
          AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00')""",
                                         sql_effective("win")) + f"""
SELECT command, {sql_savings_cols()} FROM eff2 GROUP BY command""")
def log_session_slice(spark, sf_dir):
    """K1 -> S1 + S2 (one session, prunes its bucket) + S3 (inclusive range, prunes days) -> A7."""
    inv = read_invocations(spark, _write_log(spark, sf_dir, buckets=4), session_id="s7",
                           since="2024-01-05 00:00:00", until="2024-01-25 00:00:00")
    return rounded(savings_by_command(inv))


@register("thread_log_roundtrip", ORACLE["thread_run_facts"])
def thread_log_roundtrip(spark, sf_dir):
    """Flavour A events written as JSON lines, read back with S4, reduced by X1."""
    path = scratch(spark, "thread-events")
    write_events(trials.thread_events(spark, sf_dir), path)
    facts = X.thread_run_facts(read_thread_events(spark, path).withColumn("run_id", F.col("run_id").cast("long")))
    return facts.drop("command_counts_by_prog")


@register("message_log_roundtrip", ORACLE["message_run_facts"])
def message_log_roundtrip(spark, sf_dir):
    """Flavour B events written as JSON lines, read back with S5, reduced by X2."""
    path = scratch(spark, "message-events")
    write_events(trials.message_events(spark, sf_dir), path)
    facts = X.message_run_facts(read_message_events(spark, path).withColumn("run_id", F.col("run_id").cast("long")))
    return facts.drop("command_counts_by_prog")


# Files of one folder of checklists, folders read at a time (their listing is held by
# the driver), and what opening a file counts in bytes when small files are dealt to
# tasks (Spark's 4 MB would make a task of 32 files).
_FOLDER_FILES = 1 << 9
_FOLDERS_AT_ONCE = 1 << 6
_OPEN_COST = str(1 << 16)
_WRITE_TASKS = 1 << 10
_NAME_RE = "^<!-- doc_id: (-?\\d*) -->\n"


def write_checklists(docs, path: str) -> None:
    """One markdown file per document id, which its first line names, in folders of
    about ``_FOLDER_FILES`` files that one task each writes (a folder per document
    would cost a commit, a listing and a partition value each).  Texts that share an
    id follow one another in its file."""
    folders = docs.count() // _FOLDER_FILES + 1
    dealt = docs.withColumn("folder", F.pmod(F.xxhash64("doc_id"), F.lit(folders))).repartition(min(folders, _WRITE_TASKS), "folder")
    one = dealt.groupBy("folder", "doc_id").agg(             # an id is in one folder: not shuffled again
        F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text"))
    name = F.concat(F.lit("<!-- doc_id: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" -->\n"))
    files = one.select("folder", F.concat(name, "text").alias("value"),
                       F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("none")).alias("name"))
    root, fs = _hadoop(docs.sparkSession, path)
    uri = root.makeQualified(fs.getUri(), root).toUri()
    if uri.getScheme() == "file":
        files = files.select("folder", F.col("value").cast("binary"), "name")
        n = files.mapInArrow(partial(_write_files, uri.getPath()), "n long").agg(F.sum("n")).first()[0]
        if not n:
            fs.mkdirs(root)
    else:
        files.drop("name").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)


def _write_files(root: str, batches):
    """The rows' files below a local (or mounted) folder.  Hadoop's local file system
    would start two ``chmod`` processes for each file.  A file appears whole and at
    once, so a task that runs again changes nothing."""
    import os

    import pyarrow as pa
    for batch in batches:
        for folder, value, name in zip(*(c.to_pylist() for c in batch.columns)):
            to = f"{root}/folder={folder}"
            os.makedirs(to, exist_ok=True)
            part = f"{to}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(value + b"\n")
            os.replace(part, f"{to}/part-{name}.md")
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _hadoop(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_folders(spark, path: str):
    """S7 on every folder below ``path``, some at a time: the names and sizes of files
    that are read together stand in the driver's memory."""
    root, fs = _hadoop(spark, path)
    found = sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory())
    return cut_parts(spark, [partial(read_documents, spark, found[k:k + _FOLDERS_AT_ONCE])
                             for k in range(0, len(found), _FOLDERS_AT_ONCE)]) if found else read_documents(spark, path)


@contextmanager
def _small_files(spark):
    """Thousands of files to a task while the block runs."""
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, _OPEN_COST)
    try:
        yield
    finally:
        spark.conf.set(key, was)


@register("checklist_files_roundtrip", ORACLE["checklist_status"])
def checklist_files_roundtrip(spark, sf_dir):
    """Checklists written as one markdown file per document, read with S7, C3."""
    path = scratch(spark, "checklists")
    write_checklists(checklists.checklist_docs(spark, sf_dir), path)
    free_shuffles(spark)
    with _small_files(spark):            # each file is opened once, C3 reads the texts twice
        files = read_folders(spark, path).select(
            F.regexp_extract("text", _NAME_RE, 1).try_cast("long").alias("doc_id"),
            F.regexp_replace("text", _NAME_RE, "").alias("text"))
    folder, fs = _hadoop(spark, path)    # the files have been read: a block of disk each
    fs.delete(folder, True)
    s = checklist_status(files)
    return s.select("doc_id", "phase_count", "all_tasks_done", "next_task_title", "next_task_line",
                    "next_task_phase", "next_task_phase_index",
                    F.col("current_phase.pending_tasks").alias("current_phase_pending"))


@register("trial_report", with_ctes(trials._SQL_RUNS, trials._SQL_STATS) + """
SELECT 'trial' AS kind, trial AS index, max(CASE WHEN trial % 2 = 0 THEN 'treatment-first' ELSE 'baseline-first' END) AS "order",
       CAST(max(baseline) FILTER (WHERE metric = 'input_tokens') AS BIGINT) AS number,
       round(max(delta_pct) FILTER (WHERE metric = 'output_tokens'), 4) AS pct,
       (SELECT string_agg(variant || ':' || command_count || ':' || returncode, '|' ORDER BY variant) FROM runs r WHERE r.trial = deltas.trial) AS results
FROM deltas GROUP BY trial
UNION ALL
SELECT 'report', NULL, NULL, (SELECT count(DISTINCT trial) FROM runs), round((SELECT mean_pct FROM stats WHERE metric = 'output_tokens'), 4), NULL""")
def trial_report(spark, sf_dir):
    """K2: the JSON documents with run facts, read back field by field."""
    runs = trials.trial_runs(spark, sf_dir)
    d = X.with_order(X.trial_deltas(runs))
    j = trial_report_json(d, X.aggregate_deltas(d), runs)
    shape = """`order` string, trial_count long, summary struct<metrics: map<string, struct<baseline: long, delta_pct: double>>>,
               aggregate map<string, struct<mean_pct: double>>, results array<struct<name: string, command_count: string, returncode: string>>"""
    j = j.select("kind", "index", F.from_json("json", shape, {"mode": "FAILFAST"}).alias("j"))
    return rounded(j.select(
        "kind", "index", F.col("j.order").alias("order"),
        F.coalesce("j.trial_count", F.col("j.summary.metrics")["input_tokens"]["baseline"]).alias("number"),
        F.coalesce(F.col("j.aggregate")["output_tokens"]["mean_pct"], F.col("j.summary.metrics")["output_tokens"]["delta_pct"]).alias("pct"),
        F.when(F.col("j.results").isNotNull(), F.array_join(F.transform("j.results", lambda r: F.concat_ws(
            ":", r["name"], r["command_count"], r["returncode"])), "|")).alias("results")))


def _sql_pct(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE printf('%+.1f%%', {c}) END"


_CELLS = " || ' | ' || ".join(
    f"coalesce(CAST(max({side}) FILTER (WHERE metric = '{m}') AS VARCHAR), 'None')" if side != "delta_pct"
    else _sql_pct(f"max(delta_pct) FILTER (WHERE metric = '{m}')")
    for m, _ in X.METRICS for side in ("baseline", "treatment", "delta_pct"))


@register("trial_report_rows", with_ctes(trials._SQL_RUNS, trials._SQL_STATS) + f"""
SELECT 1 AS section, CAST(trial AS BIGINT) AS position,
       '| ' || trial || ' | ' || CASE WHEN trial % 2 = 0 THEN 'treatment-first' ELSE 'baseline-first' END || ' | ' || {_CELLS} || ' |' AS line
FROM deltas GROUP BY trial
UNION ALL
SELECT 2, CASE metric WHEN 'input_tokens' THEN 0 WHEN 'output_tokens' THEN 1 ELSE 2 END,
       '| ' || label || ' | ' || {_sql_pct('mean_pct')} || ' | ' || {_sql_pct('median_pct')} || ' | '
       || CASE WHEN stdev IS NULL THEN 'n/a' ELSE printf('%.1fpp', stdev) END || ' |' FROM stats
UNION ALL SELECT 0, 4, '**Trials:** ' || count(DISTINCT trial) || '  ' FROM deltas
UNION ALL SELECT * FROM (VALUES
  (0, 0, '# Trial Results'), (0, 1, ''), (0, 2, '**Repo:** `orders`  '), (0, 3, '**Base:** `main`  '), (0, 5, '**Generated:** 2024-01-01 00:00 UTC'),
  (0, 6, ''), (1, -4, '## Per-trial results'), (1, -3, ''),
  (1, -2, '| Trial | Order | Input Tokens (baseline) | Input Tokens (treatment) | Delta | Output Tokens (baseline) | Output Tokens (treatment) | Delta | Commands (baseline) | Commands (treatment) | Delta |'),
  (1, -1, '| ----- | ----- | ----------------------- | ------------------------ | ----- | ------------------------ | ------------------------- | ----- | ------------------- | -------------------- | ----- |'),
  (2, -5, ''), (2, -4, '## Aggregate (treatment vs baseline delta)'), (2, -3, ''),
  (2, -2, '| Metric | Mean | Median | Std Dev |'), (2, -1, '| ------ | ---- | ------ | ------- |'))""")
def trial_report_rows_q(spark, sf_dir):
    """K3: the report's lines in document order."""
    d = X.with_order(X.trial_deltas(trials.trial_runs(spark, sf_dir)))
    return trial_report_lines(d, X.aggregate_deltas(d), repo="orders", base="main", generated="2024-01-01 00:00 UTC")


@register("trial_report_document", with_ctes(trials._SQL_RUNS, trials._SQL_STATS) + """
SELECT 'orders' AS repo, 'main' AS base, (SELECT count(DISTINCT trial) FROM runs) AS trial_count,
       (SELECT round(mean_pct, 4) FROM stats WHERE metric = 'output_tokens') AS mean_pct,
       (SELECT string_agg(t, '|' ORDER BY trial) FROM (
          SELECT trial, concat_ws(':', trial, max(CASE WHEN trial % 2 = 0 THEN 'treatment-first' ELSE 'baseline-first' END),
                                  CAST(max(baseline) FILTER (WHERE metric = 'input_tokens') AS BIGINT)) AS t FROM deltas GROUP BY trial)) AS trials""")
def trial_report_document_q(spark, sf_dir):
    """K2: the report as one JSON document, read back."""
    runs = trials.trial_runs(spark, sf_dir)
    d = X.with_order(X.trial_deltas(runs))
    j = trial_report_document(d, X.aggregate_deltas(d), runs, repo="orders", base="main")
    shape = """repo string, base string, trial_count long, aggregate map<string, struct<mean_pct: double>>,
               trials array<struct<index: long, `order`: string, summary: struct<metrics: map<string, struct<baseline: long>>>>>"""
    j = j.select(F.from_json("json", shape, {"mode": "FAILFAST"}).alias("j"))
    return rounded(j.select("j.repo", "j.base", "j.trial_count", F.col("j.aggregate")["output_tokens"]["mean_pct"].alias("mean_pct"),
                            F.array_join(F.transform("j.trials", lambda t: F.concat_ws(
                                ":", t["index"], t["order"], t["summary"]["metrics"]["input_tokens"]["baseline"].cast("string"))), "|").alias("trials")))


# Log lines that a reader must survive, made from events.  Kept: good records, a
# mistyped field, white space around the record (tab, no-break space), a key that
# repeats (the last counts), NaN for a number and in a string.  Skipped: bad JSON, a
# list, nothing, two records, text after a record.
_LINE = """CASE CAST(event_id % 16 AS INT)
  WHEN 1 THEN '{bad json ' || event_id
  WHEN 2 THEN '[1, 2]'
  WHEN 3 THEN ''
  WHEN 4 THEN TAB || '{"session_id":"00' || user_id || '","command":"' || event_type || '","stdout_lines":' || (event_id % 50) || '.0}'
  WHEN 5 THEN '{"session_id":"00' || user_id || '","command":"' || event_type || '","args":"x","stdout_lines":"many"}'
  WHEN 6 THEN '{"session_id":"x","stdout_lines":1,"session_id":"00' || user_id || '","command":"' || event_type || '","stdout_lines":' || (event_id % 50) || '}'
  WHEN 7 THEN '{"session_id":"00' || user_id || '","command":"' || event_type || '","stdout_lines":NaN}'
  WHEN 8 THEN NBSP || '{"session_id":"00' || user_id || '","command":"' || event_type || '","stdout_lines":' || (event_id % 50) || '}' || NBSP
  WHEN 9 THEN '{"session_id":"00' || user_id || '","command":"' || event_type || '"} {"command":"two"}'
  WHEN 10 THEN '{"session_id":"00' || user_id || '","command":"' || event_type || '"} tail'
  WHEN 11 THEN '{"session_id":"00' || user_id || '","cwd":"NaN, \\\\"Infinity","command":"' || event_type || '","exit_code":-Infinity,"stdout_lines":' || (event_id % 50) || '}'
  WHEN 12 THEN '{"session_id":"00' || user_id || '","command":"' || event_type || '"}] }'
  ELSE '{"session_id":"00' || user_id || '","command":"' || event_type || '","stdout_lines":' || (event_id % 50) || '}' END"""


@register("log_bad_lines", """
SELECT '00' || user_id AS session_id, event_type AS command, CASE WHEN event_id % 16 = 11 THEN 'NaN, "Infinity' END AS cwd, count(*) AS calls,
       CAST(sum(CASE WHEN event_id % 16 NOT IN (5, 7) THEN event_id % 50 END) AS BIGINT) AS raw_lines
FROM events WHERE event_id % 16 NOT IN (1, 2, 3, 9, 10, 12) GROUP BY 1, 2, 3""")
def log_bad_lines(spark, sf_dir):
    """S1 on a log with every kind of line above and ids with leading zeros."""
    path = scratch(spark, "bad-log")
    sql = _LINE.replace("TAB", "'\t'").replace("NBSP", "'\u00a0'")
    table(spark, sf_dir, "events").select(F.expr(sql).alias("value")).write.text(path)
    inv = read_invocations(spark, path)
    return inv.groupBy("session_id", "command", "cwd").agg(F.count(F.lit(1)).alias("calls"), F.sum("stdout_lines").alias("raw_lines"))


@register("cases_roundtrip", """
SELECT 'echo ' || role AS command, len(string_split(text, ' ')) AS n_args, count(*) AS cases
FROM conversations WHERE turn % 4 <> 3 GROUP BY 1, 2""")
def cases_roundtrip(spark, sf_dir):
    """Cases written as JSON lines among empty commands and bad lines."""
    path = scratch(spark, "cases")
    c = table(spark, sf_dir, "conversations")
    case = F.to_json(F.struct(F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("echo "), "role")).alias("command"),
                              F.split("text", " ").alias("args")))
    c.select(F.explode(F.array(case, F.lit("{broken"), F.lit(""), F.lit("7"))).alias("value")).write.text(path)
    return read_cases(spark, path).groupBy("command", F.size("args").alias("n_args")).agg(F.count(F.lit(1)).alias("cases"))
