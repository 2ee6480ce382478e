"""Registered checklist queries (C1-C3, K4) over ``documents`` rendered as task lists.

Each document line i (0-based) becomes: ``## Phase <i div 6 + 1>`` when i is a
multiple of 6, a non-phase heading ``## Notes`` when i mod 10 = 5, else a task
``- [x] <line>`` (odd i) or ``- [ ] <line>`` (even i).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.checklist import checklist_json, checklist_phases, checklist_status
from .catalog import register, sql_lines, with_ctes
from .inputs import table


def checklist_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")

    def render(x, i):
        return (F.when(i % 6 == 0, F.concat(F.lit("## Phase "), (F.floor(i / 6) + 1).cast("string")))
                .when(i % 10 == 5, F.lit("## Notes"))
                .when(i % 2 == 1, F.concat(F.lit("- [x] "), x))
                .otherwise(F.concat(F.lit("- [ ] "), x)))

    md = F.array_join(F.transform(F.split("text", "\n", -1), render), "\n")
    return d.select("doc_id", md.alias("text"))


_WS = "[\\s\\x1c-\\x1f]"
_SQL = with_ctes(sql_lines("documents", "doc_id", "text"), f"""
_md AS (
  SELECT output_id AS doc_id, CAST(line_no + 1 AS INTEGER) AS line,
         CASE WHEN line_no % 6 = 0 THEN '## Phase ' || CAST(line_no // 6 + 1 AS VARCHAR)
              WHEN line_no % 10 = 5 THEN '## Notes'
              WHEN line_no % 2 = 1 THEN '- [x] ' || replace(line, chr(10), '')
              ELSE '- [ ] ' || replace(line, chr(10), '') END AS md
  FROM lines
),
_r AS (
  SELECT doc_id, line, regexp_replace(md, '{_WS}+$', '') AS raw FROM _md
),
_p AS (
  SELECT *, starts_with(raw, '## ') AS heading,
         starts_with(raw, '## ') AND starts_with(regexp_replace(substr(raw, 4), '^{_WS}+|{_WS}+$', '', 'g'), 'Phase ')
           AS is_phase
  FROM _r
),
_q AS (
  SELECT *, CAST(sum(CASE WHEN is_phase THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS phase_index
  FROM _p
),
phases AS (
  SELECT doc_id, phase_index, regexp_replace(substr(raw, 4), '^{_WS}+|{_WS}+$', '', 'g') AS title, line
  FROM _q WHERE is_phase
),
tasks AS (
  SELECT doc_id, phase_index, regexp_replace(substr(raw, 7), '^{_WS}+|{_WS}+$', '', 'g') AS title,
         lower(substr(raw, 4, 1)) = 'x' AS done, line
  FROM _q
  WHERE NOT heading AND starts_with(raw, '- [') AND length(raw) >= 7 AND lower(substr(raw, 4, 1)) IN (' ', 'x')
    AND substr(raw, 5, 1) = ']' AND substr(raw, 6, 1) = ' ' AND phase_index > 0
    AND regexp_replace(substr(raw, 7), '^{_WS}+|{_WS}+$', '', 'g') <> ''
),
_agg AS (
  SELECT doc_id, phase_index, count(*) AS total, count(*) FILTER (WHERE done) AS comp,
         arg_min(title, line) FILTER (WHERE NOT done) AS next_task
  FROM tasks GROUP BY doc_id, phase_index
),
summary AS (
  SELECT p.doc_id, p.phase_index, p.title, p.line, CAST(coalesce(a.total, 0) AS BIGINT) AS total_tasks,
         CAST(coalesce(a.comp, 0) AS BIGINT) AS completed_tasks,
         CAST(coalesce(a.total, 0) - coalesce(a.comp, 0) AS BIGINT) AS pending_tasks,
         coalesce(a.total, 0) > 0 AND coalesce(a.total, 0) = coalesce(a.comp, 0) AS completed, a.next_task
  FROM phases p LEFT JOIN _agg a ON a.doc_id = p.doc_id AND a.phase_index = p.phase_index
)""")


@register("checklist_phases", _SQL + """
SELECT * FROM summary""")
def checklist_phases_q(spark, sf_dir):
    """C1 + C2."""
    return checklist_phases(checklist_docs(spark, sf_dir)).drop("next_task_line")


@register("checklist_status", _SQL + """,
_pc AS (SELECT doc_id, count(*) AS phase_count FROM phases GROUP BY doc_id),
_nt AS (SELECT doc_id, arg_min(title, line) AS t, min(line) AS l, arg_min(phase_index, line) AS pi
        FROM tasks WHERE NOT done GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(pc.phase_count, 0) AS BIGINT) AS phase_count, nt.doc_id IS NULL AS all_tasks_done,
       nt.t AS next_task_title, nt.l AS next_task_line, s.title AS next_task_phase, nt.pi AS next_task_phase_index,
       s.pending_tasks AS current_phase_pending
FROM documents d
LEFT JOIN _pc pc ON pc.doc_id = d.doc_id
LEFT JOIN _nt nt ON nt.doc_id = d.doc_id
LEFT JOIN summary s ON s.doc_id = d.doc_id AND s.phase_index = nt.pi""")
def checklist_status_q(spark, sf_dir):
    """C1 + C3 (the current phase's pending count stands for the nested phase)."""
    s = checklist_status(checklist_docs(spark, sf_dir))
    return s.select("doc_id", "phase_count", "all_tasks_done", "next_task_title", "next_task_line",
                    "next_task_phase", "next_task_phase_index",
                    F.col("current_phase.pending_tasks").alias("current_phase_pending"))


@register("checklist_json", _SQL + """,
_pc AS (SELECT doc_id, count(*) AS n, sum(total_tasks) AS tasks, string_agg(title, '|' ORDER BY phase_index) AS titles,
               string_agg(CAST(line AS VARCHAR), '|' ORDER BY phase_index) AS lines FROM summary GROUP BY doc_id),
_nt AS (SELECT doc_id, arg_min(title, line) AS t, min(line) AS l, arg_min(phase_index, line) AS pi
        FROM tasks WHERE NOT done GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(_pc.n, 0) AS BIGINT) AS phase_count, _nt.doc_id IS NULL AS all_tasks_done, _nt.t AS next_title,
       CAST(_nt.l AS BIGINT) AS next_line, s.title AS next_phase, CAST(s.pending_tasks AS BIGINT) AS pending_tasks,
       CAST(coalesce(_pc.n, 0) AS BIGINT) AS n_phases, coalesce(_pc.titles, '') AS titles, coalesce(_pc.lines, '') AS lines,
       CAST(coalesce(_pc.tasks, 0) AS BIGINT) AS total_tasks, 'doc/' || d.doc_id || '.md' AS path
FROM documents d LEFT JOIN _pc ON _pc.doc_id = d.doc_id LEFT JOIN _nt ON _nt.doc_id = d.doc_id
LEFT JOIN summary s ON s.doc_id = d.doc_id AND s.phase_index = _nt.pi""")
def checklist_json_q(spark, sf_dir):
    """K4: the JSON objects, read back field by field."""
    docs = checklist_docs(spark, sf_dir).withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")))
    shape = """phase_count long, all_tasks_done boolean, next_task struct<title: string, line: long, phase: string>,
               current_phase struct<pending_tasks: long>, phases array<struct<title: string, line: string, total_tasks: long>>, tasklist_path string"""
    j = checklist_json(docs, path="path").select("doc_id", F.from_json("json", shape, {"mode": "FAILFAST"}).alias("j"))
    return j.select(
        "doc_id", "j.phase_count", "j.all_tasks_done", F.col("j.next_task.title").alias("next_title"),
        F.col("j.next_task.line").alias("next_line"), F.col("j.next_task.phase").alias("next_phase"),
        F.col("j.current_phase.pending_tasks").alias("pending_tasks"), F.size("j.phases").cast("long").alias("n_phases"),
        F.array_join("j.phases.title", "|").alias("titles"), F.array_join("j.phases.line", "|").alias("lines"),
        F.aggregate("j.phases.total_tasks", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_tasks"),
        F.col("j.tasklist_path").alias("path"))
