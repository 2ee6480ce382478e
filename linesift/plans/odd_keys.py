"""Registered queries over inputs whose ids are missing or repeated."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators.checklist import checklist_status
from ..operators.document import document_view
from ..operators.hits import compact_search_hits
from ..operators.listing import compact_listing
from ..operators.scan import cut, cut_parts
from ..operators.vcs import cap_log_entries
from . import checklists, documents, listing, search, vcs
from .catalog import ORACLE, register

_ID = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN doc_id // 10 ELSE doc_id END"


@register("checklist_odd_ids", f"""
WITH s AS ({ORACLE["checklist_status"]})
SELECT {_ID} AS doc_id, phase_count, all_tasks_done, next_task_title, next_task_line FROM s
UNION ALL SELECT {_ID}, phase_count, all_tasks_done, next_task_title, next_task_line FROM s WHERE doc_id % 11 = 0""")
def checklist_odd_ids(spark, sf_dir):
    """C3 where every 7th document has no id, every 5th shares another's, and every
    11th row stands twice: each row has the status of its own text."""
    d = checklists.checklist_docs(spark, sf_dir)
    d = d.unionByName(d.where("doc_id % 11 = 0"))
    d = d.withColumn("doc_id", F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN doc_id div 10 ELSE doc_id END"))
    return checklist_status(d).select("doc_id", "phase_count", "all_tasks_done", "next_task_title", "next_task_line")


# The output of each family that loses its id.
_LOST = {"search": "0", "log": "1", "listing": "'pages-en'", "file": "1"}
_FAMILIES = {"search": "search_hits", "log": "log_entry_cap", "listing": "listing_sample", "file": "document_view"}


@register("null_output_ids", "\nUNION ALL ".join(f"""
SELECT '{f}' AS family, CAST(nullif(output_id, {_LOST[f]}) AS VARCHAR) AS output_id, count(*) AS lines_out,
       CAST(sum(n_omitted) AS BIGINT) AS omitted FROM ({ORACLE[q]}) GROUP BY 1, 2""" for f, q in _FAMILIES.items()))
def null_output_ids(spark, sf_dir):
    """T3, T4, T6-T9 and T12 on outputs one of which has no id: none loses a line."""
    def lost(df, family):
        return df.withColumn("output_id", F.expr(f"nullif(output_id, {_LOST[family]})"))

    def file():
        vl, vf = documents.view_files(spark, sf_dir)
        return document_view(lost(vl, "file"), lost(vf, "file"))

    found = {"search": lambda: compact_search_hits(lost(search.search_output_lines(spark, sf_dir), "search")),
             "log": lambda: cap_log_entries(lost(cut(vcs.log_lines(spark, sf_dir)), "log"), leaf=True),
             "listing": lambda: compact_listing(lost(listing.listing_lines(spark, sf_dir), "listing")),
             "file": file}

    def counted(family):
        df = found[family]()
        return df.groupBy("output_id").agg(F.count(F.lit(1)).alias("lines_out"), F.sum("n_omitted").alias("omitted")) \
            .select(F.lit(family).alias("family"), F.col("output_id").cast("string").alias("output_id"), "lines_out", "omitted")

    # one family after another: the disk holds the lines and scans of one at a time
    return cut_parts(spark, [partial(counted, f) for f in found])
