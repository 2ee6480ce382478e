"""Registered compaction queries (T0-T16) over ``documents``-derived outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lines import to_lines
from ..operators.metrics import compaction_metrics
from ..operators.runs import collapse_runs, truncate_tail
from ..operators.usage import savings_by_command
from .catalog import (register, rounded, sql_collapse, sql_effective, sql_lines, sql_savings_cols,
                      with_ctes)
from .inputs import document_outputs

_DOC_LINES = sql_lines("documents", "doc_id", "text")


def _doc_compacted(spark, sf_dir, limit):
    outputs = document_outputs(spark, sf_dir)
    return outputs, collapse_runs(to_lines(outputs), limit=limit)


@register("run_collapse", with_ctes(_DOC_LINES, sql_collapse(None)) + """
SELECT output_id, seq, kind, src_line_no, line, n_omitted FROM compacted""")
def run_collapse(spark, sf_dir):
    """T0 + T1: every document's lines with runs of > 3 equal lines collapsed."""
    return _doc_compacted(spark, sf_dir, None)[1]


@register("generic_compaction", with_ctes(_DOC_LINES, sql_collapse(200)) + """
SELECT output_id, seq, kind, src_line_no, line, n_omitted FROM compacted""")
def generic_compaction(spark, sf_dir):
    """T0 + T1 + T2: the generic strategy (collapse, then cut at 200 rows)."""
    return _doc_compacted(spark, sf_dir, 200)[1]


@register("generic_compaction_short", with_ctes(_DOC_LINES, sql_collapse(20)) + """
SELECT output_id, seq, kind, src_line_no, line, n_omitted FROM compacted""")
def generic_compaction_short(spark, sf_dir):
    """T1, then T2 on its own (``truncate_tail``) at 20 rows, which long documents pass."""
    return truncate_tail(_doc_compacted(spark, sf_dir, None)[1], limit=20)


_SAVINGS_BY_SOURCE_SQL = with_ctes(_DOC_LINES, sql_collapse(200), """
_out AS (SELECT output_id, count(*) AS lines_out FROM compacted GROUP BY output_id),
_cnt AS (SELECT output_id, count(*) AS line_count FROM lines GROUP BY output_id),
inv AS (
  SELECT d.source AS command,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS BIGINT) AS stdout_lines,
         CAST(strlen(d.text) AS BIGINT) AS stdout_bytes,
         CASE WHEN coalesce(o.lines_out, 0) <> coalesce(c.line_count, 0)
              THEN CAST(coalesce(o.lines_out, 0) AS BIGINT) END AS compressed_lines,
         false AS "full"
  FROM documents d
  LEFT JOIN _out o ON o.output_id = d.doc_id
  LEFT JOIN _cnt c ON c.output_id = d.doc_id
)""", sql_effective("inv")) + f"""
SELECT command, {sql_savings_cols()}
FROM eff2 GROUP BY command"""


@register("compaction_savings_by_source", _SAVINGS_BY_SOURCE_SQL)
def compaction_savings_by_source(spark, sf_dir):
    """Flagship: T0 -> T1 -> T2 -> T16 -> A7.  How much does the generic strategy
    save per document source?  The log facts of T16 feed the savings report
    directly (no JSON round trip)."""
    outputs, compacted = _doc_compacted(spark, sf_dir, 200)
    facts = compaction_metrics(outputs, compacted)
    inv = facts.select("command", "stdout_lines", "stdout_bytes", "compressed_lines",
                       F.lit(False).alias("full"), F.lit(None).cast("string").alias("session_id"))
    return rounded(savings_by_command(inv))


# ------------------------------------------------------------- B1 / B2

def _comparison(spark, sf_dir):
    from ..operators.compare import compare_outputs, rendered_facts
    outputs, compacted = _doc_compacted(spark, sf_dir, 200)
    facts = compaction_metrics(outputs, compacted)
    raw = facts.select(F.col("output_id").alias("case_id"), F.col("stdout_lines").alias("raw_lines"),
                       F.col("stdout_bytes").alias("raw_bytes"), F.lit(0).alias("raw_rc"))
    comp = rendered_facts(compacted, facts).select(F.col("output_id").alias("case_id"), "compact_lines",
                                                  "compact_bytes", F.lit(0).alias("compact_rc"))
    return compare_outputs(raw, comp)


_CMP_SQL = with_ctes(_DOC_LINES, sql_collapse(200), """
_cnt AS (SELECT output_id, count(*) AS line_count FROM lines GROUP BY output_id),
_body AS (SELECT output_id, count(*) AS lines_out, count(*) FILTER (WHERE ends_with(line, chr(10))) AS bl,
                 sum(strlen(line)) AS bb FROM compacted GROUP BY output_id),
_f AS (
  SELECT d.doc_id AS case_id,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS BIGINT) AS raw_lines,
         CAST(strlen(d.text) AS BIGINT) AS raw_bytes,
         coalesce(c.line_count, 0) AS line_count, coalesce(b.lines_out, 0) AS lines_out,
         coalesce(b.bl, 0) AS bl, coalesce(b.bb, 0) AS bb
  FROM documents d LEFT JOIN _cnt c ON c.output_id = d.doc_id LEFT JOIN _body b ON b.output_id = d.doc_id
),
_h AS (
  SELECT *, bb > 0 AND line_count - lines_out >= 5 AS shown,
         strlen('# linesift: ' || CAST(line_count AS VARCHAR) || ' → ' || CAST(lines_out AS VARCHAR) || ' lines' || chr(10))
           AS hb
  FROM _f
),
cmp AS (
  SELECT case_id, raw_lines, raw_bytes, 0 AS raw_rc,
         CAST(bl + CASE WHEN shown THEN 1 ELSE 0 END AS BIGINT) AS compact_lines,
         CAST(bb + CASE WHEN shown THEN hb ELSE 0 END AS BIGINT) AS compact_bytes, 0 AS compact_rc
  FROM _h
)""")


@register("compare_outputs", _CMP_SQL + """
SELECT case_id, raw_lines, raw_bytes, compact_lines, compact_bytes,
       round(CASE WHEN raw_lines <> 0 THEN CAST(compact_lines AS DOUBLE) / raw_lines ELSE 1.0::DOUBLE END, 4) AS line_ratio,
       round(CASE WHEN raw_bytes <> 0 THEN CAST(compact_bytes AS DOUBLE) / raw_bytes ELSE 1.0::DOUBLE END, 4) AS byte_ratio,
       raw_rc = compact_rc AS success
FROM cmp""")
def compare_outputs_q(spark, sf_dir):
    """B1: every document raw vs its generic compaction (header included)."""
    return rounded(_comparison(spark, sf_dir).select("case_id", "raw_lines", "raw_bytes", "compact_lines",
                                                     "compact_bytes", "line_ratio", "byte_ratio", "success"))


@register("comparison_summary", _CMP_SQL + """
SELECT CAST(count(*) AS BIGINT) AS cases,
       round(avg(CASE WHEN raw_lines <> 0 THEN CAST(compact_lines AS DOUBLE) / raw_lines ELSE 1.0::DOUBLE END), 4)
         AS avg_line_ratio,
       round(avg(CASE WHEN raw_bytes <> 0 THEN CAST(compact_bytes AS DOUBLE) / raw_bytes ELSE 1.0::DOUBLE END), 4)
         AS avg_byte_ratio,
       CAST(count(*) FILTER (WHERE raw_rc = compact_rc) AS BIGINT) AS matching_exit_codes
FROM cmp""")
def comparison_summary_q(spark, sf_dir):
    """B2."""
    from ..operators.compare import comparison_summary
    return rounded(comparison_summary(_comparison(spark, sf_dir)))
