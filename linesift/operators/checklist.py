"""Markdown checklist progress.

Input ``docs(doc_id, text)``.  A ``## Phase ...`` heading opens a phase (other
``## `` headings do not close it); a task is ``- [ ] title`` / ``- [x] title``
(marker space, x or X at column 0, exactly one space after ``]``, non-empty
title) inside a phase.  Lines are 1-based, split as str.splitlines.

A document is its id and text: documents that share an id, or have none, are told
apart by their texts, and rows equal in both are one document (C1, C2), whose status
every such row gets (C3, K4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_rstrip, py_strip
from .lines import to_lines
from .scan import CHUNK_COL, WRAPPED, segmented_scan


_DOC = "_document"


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add the document's identity, which is never NULL."""
    return docs.withColumn(_DOC, F.struct(F.col(key).alias(WRAPPED), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text")))


def _id(key: str):
    return F.col(f"{_DOC}.{WRAPPED}").alias(key)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """One pass over the lines: phase/task flags and the running phase index."""
    lines = to_lines(docs.select(F.col(_DOC).alias("output_id"), F.col(text).alias("stdout")), universal=True)
    lines = lines.select(F.col("output_id").alias(_DOC), (F.col("line_no") + 1).alias("line"),
                         py_rstrip(F.col("line")).alias("raw"))
    heading = F.col("raw").startswith("## ")
    head_title = py_strip(F.substring(F.col("raw"), 4, 1 << 30))
    is_phase = heading & head_title.startswith("Phase ")
    lines = lines.withColumns({"_heading": heading, "_phase": is_phase.cast("int"), "_htitle": head_title})
    lines = segmented_scan(lines, [_DOC], "line", running_sum={"phase_index": F.col("_phase")}, distinct=True).drop(CHUNK_COL)
    marker = F.lower(F.substring("raw", 4, 1))
    title = py_strip(F.substring("raw", 7, 1 << 30))
    task = (~F.col("_heading") & F.col("raw").startswith("- [") & (F.length("raw") >= 7)
            & marker.isin(" ", "x") & (F.substring("raw", 5, 1) == "]") & (F.substring("raw", 6, 1) == " ")
            & (F.col("phase_index") > 0) & (title != ""))
    return lines.select(_DOC, "phase_index", "line", (F.col("_phase") == 1).alias("is_phase"),
                        F.col("_htitle").alias("phase_title"), task.alias("is_task"),
                        F.when(task, title).alias("title"), (task & (marker == "x")).alias("done"))


def checklist_tasks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phases, tasks).

    phases: ``doc_id, phase_index, title, line``;
    tasks:  ``doc_id, phase_index, title, done, line``.
    """
    lines = _lines(_documents(docs, key, text), text)
    phases = lines.where("is_phase").select(_id(key), "phase_index", F.col("phase_title").alias("title"), "line")
    tasks = lines.where("is_task").select(_id(key), "phase_index", "title", "done", "line")
    return phases, tasks


def checklist_phases(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per phase: totals, done, pending, completed flag, first open task.

    One hash aggregate over the phase and task lines (a phase row carries the
    title and line, task rows the counts), so the lines are scanned once."""
    return _phases(_documents(docs, key, text), text).select(_id(key), "*").drop(_DOC)


def _phases(docs: DataFrame, text: str) -> DataFrame:
    lines = _lines(docs, text).where(F.col("is_phase") | F.col("is_task"))
    open_t = F.col("is_task") & ~F.col("done")
    agg = lines.groupBy(_DOC, "phase_index").agg(
        F.max(F.when(F.col("is_phase"), F.col("phase_title"))).alias("title"),
        F.max(F.when(F.col("is_phase"), F.col("line"))).alias("line"),
        F.count_if("is_task").alias("total_tasks"), F.count_if("done").alias("completed_tasks"),
        F.min_by(F.when(open_t, F.col("title")), F.when(open_t, F.col("line"))).alias("next_task"),
        F.min(F.when(open_t, F.col("line"))).alias("next_task_line"))
    return agg.select(_DOC, "phase_index", "title", "line", "total_tasks", "completed_tasks",
                      (F.col("total_tasks") - F.col("completed_tasks")).alias("pending_tasks"),
                      ((F.col("total_tasks") > 0) & (F.col("total_tasks") == F.col("completed_tasks"))).alias("completed"),
                      "next_task", "next_task_line")


def checklist_status(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: phase count, all-done flag, next task (title, line,
    phase title, phase index) and the current phase (the next task's phase),
    from the per-phase summary (one row per phase)."""
    return _status(_documents(docs, key, text), text, key).drop(_DOC)


def _status(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    ph = _phases(docs, text)
    phase = F.struct(*[c for c in ph.columns if c not in (_DOC, "next_task_line")])
    per_doc = ph.groupBy(_DOC).agg(
        F.count(F.lit(1)).alias("phase_count"),
        F.min_by(F.when(F.col("next_task").isNotNull(), phase),
                 F.when(F.col("next_task").isNotNull(), F.col("phase_index"))).alias("current_phase"),
        F.min_by(F.when(F.col("next_task").isNotNull(), F.col("next_task_line")),
                 F.when(F.col("next_task").isNotNull(), F.col("phase_index"))).alias("_line"))
    d = docs.select(_DOC, *columns).join(per_doc, _DOC, "left")
    return d.select(
        _DOC, *columns, F.coalesce("phase_count", F.lit(0).cast("long")).alias("phase_count"),
        F.col("current_phase").isNull().alias("all_tasks_done"),
        F.col("current_phase.next_task").alias("next_task_title"), F.col("_line").alias("next_task_line"),
        F.col("current_phase.title").alias("next_task_phase"),
        F.col("current_phase.phase_index").alias("next_task_phase_index"), "current_phase")


def checklist_json(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """K4: one JSON object per document: phase count, all-done flag, current phase,
    next task, all phases in order (a list as long as the document has phases),
    and the document's path if there is such a column."""
    named = _documents(docs, key, text)
    phases = _phases(named, text).drop("next_task_line")
    own = F.struct(*[c for c in phases.columns if c != _DOC])
    listed = phases.groupBy(_DOC).agg(F.array_sort(F.collect_list(own)).alias("phases"))
    if path:
        named = named.withColumn("tasklist_path", F.col(path))
    d = _status(named, text, key, *(["tasklist_path"] if path else [])).join(listed, _DOC, "left")
    task = F.when(F.col("next_task_title").isNotNull(), F.struct(
        F.col("next_task_title").alias("title"), F.col("next_task_line").alias("line"), F.col("next_task_phase").alias("phase"),
        F.col("next_task_phase_index").alias("phase_index")))
    fields = [F.col("phase_count"), F.col("all_tasks_done"), F.col("current_phase"), task.alias("next_task"),
              F.coalesce("phases", F.array().cast(d.schema["phases"].dataType)).alias("phases")]
    return d.select(key, F.to_json(F.struct(*fields, *(["tasklist_path"] if path else [])),
                                   {"ignoreNullFields": "false"}).alias("json"))
