"""Registered search-hit queries (T3, T4) over ``documents`` rendered as ``rg -C2`` output.

One search output per document.  A document line matches when it contains
`` the ``; every line within 2 lines of a match is shown, as
``doc<id>/part<i div 25>.txt:<i+1>:<text>`` (match) or ``...:<i+1>-<text>``
(context); ``--`` separates groups that are not adjacent or change file.
The derivation windows are per document (bounded by one table cell).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import eol_strip
from ..operators.hits import classify_hits, compact_search_hits, hit_status, search_hit_summary
from ..operators.lines import to_lines
from .catalog import register, sql_lines, with_ctes
from .inputs import document_outputs

TOKEN = " the "
SPAN = 2
FILE_LINES = 25


def search_output_lines(spark, sf_dir):
    lines = to_lines(document_outputs(spark, sf_dir))
    t = eol_strip(F.col("line"))
    w = Window.partitionBy("output_id").orderBy("line_no")
    d = lines.select("output_id", "line_no", t.alias("t"), F.instr(t, TOKEN).__gt__(0).alias("m"),
                     F.concat(F.lit("doc"), F.col("output_id").cast("string"), F.lit("/part"),
                              F.floor(F.col("line_no") / FILE_LINES).cast("string"), F.lit(".txt")).alias("f"))
    near = F.col("m")
    for k in range(1, SPAN + 1):
        near = near | F.coalesce(F.lag("m", k).over(w), F.lit(False)) | F.coalesce(F.lead("m", k).over(w), F.lit(False))
    d = d.withColumns({"nr": near, "pf": F.lag("f").over(w)})
    d = d.withColumns({"pnr": F.lag("nr").over(w),
                       "first_i": F.min(F.when(F.col("nr"), F.col("line_no"))).over(Window.partitionBy("output_id"))})
    sep = F.col("nr") & (F.col("line_no") > F.col("first_i")) & (
        F.col("pnr").isNull() | ~F.col("pnr") | (F.col("pf") != F.col("f")))
    shown = F.concat(F.col("f"), F.lit(":"), (F.col("line_no") + 1).cast("string"),
                     F.when(F.col("m"), F.lit(":")).otherwise(F.lit("-")), F.col("t"), F.lit("\n"))
    rows = F.array(F.struct(sep.alias("k"), (F.col("line_no") * 2).alias("pos"), F.lit("--\n").alias("line")),
                   F.struct(F.col("nr").alias("k"), (F.col("line_no") * 2 + 1).alias("pos"), shown.alias("line")))
    d = d.select("output_id", F.explode(F.filter(rows, lambda r: r["k"])).alias("r"))
    return d.select("output_id", (F.row_number().over(Window.partitionBy("output_id").orderBy("r.pos")) - 1)
                    .cast("int").alias("line_no"), F.col("r.line").alias("line"))


_WS = "[ \\t\\n\\r\\x0b\\f]"
_HIT = "(?s)^(.+?):(\\d+):(.*)"
_CTX = "(?s)^(.+?):(\\d+)-(.*)"
_SQL = with_ctes(sql_lines("documents", "doc_id", "text", name="dl"), f"""
_src AS (
  SELECT output_id, line_no AS i, replace(line, chr(10), '') AS t, contains(replace(line, chr(10), ''), '{TOKEN}') AS m,
         'doc' || CAST(output_id AS VARCHAR) || '/part' || CAST(line_no // {FILE_LINES} AS VARCHAR) || '.txt' AS f
  FROM dl
),
_near AS (
  SELECT *, m OR coalesce(lag(m, 1) OVER w, false) OR coalesce(lead(m, 1) OVER w, false)
           OR coalesce(lag(m, 2) OVER w, false) OR coalesce(lead(m, 2) OVER w, false) AS nr,
         lag(f) OVER w AS pf
  FROM _src WINDOW w AS (PARTITION BY output_id ORDER BY i)
),
_near2 AS (
  SELECT *, lag(nr) OVER (PARTITION BY output_id ORDER BY i) AS pnr,
         min(CASE WHEN nr THEN i END) OVER (PARTITION BY output_id) AS first_i
  FROM _near
),
_rows AS (
  SELECT output_id, 2 * i AS pos, '--' || chr(10) AS line FROM _near2
  WHERE nr AND i > first_i AND (pnr IS NULL OR NOT pnr OR pf <> f)
  UNION ALL
  SELECT output_id, 2 * i + 1, f || ':' || CAST(i + 1 AS VARCHAR) || CASE WHEN m THEN ':' ELSE '-' END || t || chr(10)
  FROM _near2 WHERE nr
),
rg AS (
  SELECT output_id, CAST(row_number() OVER (PARTITION BY output_id ORDER BY pos) - 1 AS INTEGER) AS line_no, line
  FROM _rows
),
_cls AS (
  SELECT output_id, line_no, line, regexp_replace(line, '[\\n\\r]+$', '') AS raw FROM rg
),
cls AS (
  SELECT *, CASE WHEN raw = '--' THEN 'sep' WHEN regexp_matches(raw, '{_HIT}') THEN 'hit'
                 WHEN regexp_matches(raw, '{_CTX}') THEN 'ctx' ELSE 'other' END AS kind,
         regexp_extract(raw, '{_HIT}', 1) AS file, CAST(regexp_extract(raw, '{_HIT}', 2) AS BIGINT) AS hit_n,
         regexp_replace(regexp_extract(raw, '{_HIT}', 3), '^{_WS}+|{_WS}+$', '', 'g') AS tkey
  FROM _cls
),
_hits AS (SELECT * FROM cls WHERE kind = 'hit'),
_keys AS (
  SELECT output_id, file, tkey, min(line_no) AS first_ln FROM _hits GROUP BY output_id, file, tkey
),
_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY output_id, file ORDER BY first_ln) AS rank FROM _keys
),
st AS (
  SELECT h.output_id, h.line_no, h.file, h.hit_n,
         CASE WHEN r.rank > 5 THEN 'over_cap' WHEN h.line_no = r.first_ln THEN 'kept' ELSE 'duplicate' END AS status
  FROM _hits h JOIN _ranked r ON r.output_id = h.output_id AND r.file = h.file AND r.tkey = h.tkey
),
_ev AS (
  SELECT c.output_id, c.line_no, c.line, c.kind,
         CASE WHEN c.kind = 'sep' THEN 3 WHEN c.kind = 'other' THEN 4 WHEN s.status = 'kept' THEN 1
              WHEN c.kind = 'hit' THEN 2 END AS ev
  FROM cls c LEFT JOIN st s ON s.output_id = c.output_id AND s.line_no = c.line_no
),
_nb AS (
  SELECT *,
    max(CASE WHEN ev IS NOT NULL THEN CAST(line_no AS BIGINT) * 8 + ev END)
      OVER (PARTITION BY output_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
    min(CASE WHEN ev IS NOT NULL THEN CAST(line_no AS BIGINT) * 8 + ev END)
      OVER (PARTITION BY output_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
    min(CASE WHEN ev IS NOT NULL AND ev <> 2 THEN CAST(line_no AS BIGINT) * 8 + ev END)
      OVER (PARTITION BY output_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nnd,
    count(*) OVER (PARTITION BY output_id) AS n
  FROM _ev
),
_kp AS (
  SELECT * FROM _nb
  WHERE ev = 1 OR ev = 4 OR (ev = 3 AND nnd % 8 = 1)
     OR (kind = 'ctx' AND coalesce(nxt // 8, n) - line_no <= 2
         AND (nxt % 8 = 1 OR ((nxt IS NULL OR nxt % 8 IN (3, 4)) AND (prv IS NULL OR prv % 8 <> 2))))
),
summ AS (
  SELECT output_id, file, CAST(count(*) AS BIGINT) AS total,
         CAST(count(*) FILTER (WHERE status = 'kept') AS BIGINT) AS kept,
         CAST(count(*) FILTER (WHERE status = 'duplicate') AS BIGINT) AS duplicates,
         CAST(count(*) FILTER (WHERE status = 'over_cap') AS BIGINT) AS over_cap,
         min(line_no) AS first_hit_line
  FROM st GROUP BY output_id, file
),
_ocl AS (
  SELECT output_id, file, string_agg(CAST(hit_n AS VARCHAR), ', ' ORDER BY line_no) AS hint FROM (
    SELECT *, row_number() OVER (PARTITION BY output_id, file ORDER BY line_no) AS r FROM st WHERE status = 'over_cap')
  WHERE r <= 10 GROUP BY output_id, file
),
summary AS (
  SELECT s.*, CAST(total - kept AS BIGINT) AS omitted, coalesce(o.hint, '') AS over_cap_lines,
    '# linesift: ' || s.file || ' kept ' || CAST(kept AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' matches; '
      || CAST(total - kept AS VARCHAR) || ' more matches omitted'
      || CASE WHEN duplicates > 0 OR over_cap > 0 THEN ' (' || concat_ws(', ',
             CASE WHEN duplicates > 0 THEN CAST(duplicates AS VARCHAR) || ' duplicate' END,
             CASE WHEN over_cap > 0 THEN CAST(over_cap AS VARCHAR) || ' over cap at lines ' || o.hint
                  || CASE WHEN over_cap > 10 THEN ' (+' || CAST(over_cap - 10 AS VARCHAR) || ' more)' ELSE '' END END)
           || ')' ELSE '' END || chr(10) AS note
  FROM summ s LEFT JOIN _ocl o ON o.output_id = s.output_id AND o.file = s.file
)""")


@register("search_hits", _SQL + """,
_body AS (
  SELECT output_id, CAST(row_number() OVER (PARTITION BY output_id ORDER BY line_no) - 1 AS BIGINT) AS seq,
         'line' AS kind, line_no AS src_line_no, line, CAST(0 AS BIGINT) AS n_omitted
  FROM _kp
),
_tot AS (SELECT output_id, count(*) AS c FROM _body GROUP BY output_id)
SELECT * FROM _body
UNION ALL
SELECT s.output_id, CAST(coalesce(t.c, 0) + row_number() OVER (PARTITION BY s.output_id ORDER BY first_hit_line) - 1 AS BIGINT),
       'note', CAST(NULL AS INTEGER), note, omitted
FROM summary s LEFT JOIN _tot t ON t.output_id = s.output_id WHERE omitted > 0""")
def search_hits(spark, sf_dir):
    """T3 + T4: capped, de-duplicated search output with per-file notes."""
    return compact_search_hits(search_output_lines(spark, sf_dir))


@register("search_hit_summary", _SQL + """
SELECT output_id, file, total, kept, duplicates, over_cap, omitted, over_cap_lines, first_hit_line, note FROM summary""")
def search_hit_summary_q(spark, sf_dir):
    """T4 for every file with hits."""
    st = hit_status(classify_hits(search_output_lines(spark, sf_dir)))
    return search_hit_summary(st)
