"""Registered file-read queries.

``document_view``: every document as a file ``doc<id>.py`` (id divisible by 4)
or ``doc<id>.md``; in ``.py`` files line i mod 5 = 2 is a ``#`` comment; a
blank line follows every line with i mod 3 = 2.  The cat strategy applies:
outline for ``.py`` files over 100 lines, else the document view.

``outline_index``: every document as synthetic Python code, one code line per
document line i by i mod 7 (and i mod 28 for decorators, classes and open
signatures); text t = the document line, w = its first word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import eol_strip
from ..operators.document import OUTLINE_THRESHOLD, document_view, outline
from ..operators.lines import to_lines
from .catalog import register, sql_lines, with_ctes
from .inputs import document_outputs


def _doc_lines(spark, sf_dir):
    return to_lines(document_outputs(spark, sf_dir)).select(
        "output_id", F.col("line_no").alias("i"), eol_strip(F.col("line")).alias("t"))


def view_files(spark, sf_dir):
    """(lines, files) of the document-view derivation."""
    d = _doc_lines(spark, sf_dir)
    py = (F.col("output_id") % 4) == 0
    text = F.when(py & (F.col("i") % 5 == 2), F.concat(F.lit("# "), F.col("t"))).otherwise(F.col("t"))
    pos = F.col("i") + F.floor(F.col("i") / 3)
    rows = F.array(F.struct(F.lit(True).alias("k"), pos.alias("p"), F.concat(text, F.lit("\n")).alias("l")),
                   F.struct((F.col("i") % 3 == 2).alias("k"), (pos + 1).alias("p"), F.lit("\n").alias("l")))
    lines = d.select("output_id", F.explode(F.filter(rows, lambda r: r["k"])).alias("r")).select(
        "output_id", F.col("r.p").cast("int").alias("line_no"), F.col("r.l").alias("line"))
    files = lines.groupBy("output_id").agg(F.count(F.lit(1)).alias("total_lines")).withColumn(
        "filename", F.concat(F.lit("doc"), F.col("output_id").cast("string"),
                             F.when((F.col("output_id") % 4) == 0, F.lit(".py")).otherwise(F.lit(".md"))))
    return lines, files


def code_lines(spark, sf_dir):
    d = _doc_lines(spark, sf_dir)
    i, t = F.col("i"), F.col("t")
    w = F.regexp_extract(t, "^(\\S*)", 1)
    r, q = i % 7, i % 28
    si = i.cast("string")
    code = (F.when(r == 0, F.when(q == 0, F.lit("@cached")).when(q == 14, F.concat(F.lit("class C"), si, F.lit(":")))
                   .otherwise(F.concat(F.lit("def f"), si, F.lit("(x):"))))
            .when(r == 1, F.when(q == 1, F.concat(F.lit("def g"), si, F.lit("(y,")))
                  .when(q == 15, F.concat(F.lit('    """'), t))
                  .otherwise(F.concat(F.lit('    """'), t, F.lit('"""'))))
            .when(r == 2, F.when(q == 2, F.lit("        z):")).otherwise(F.concat(F.lit("    # "), t)))
            .when(r == 3, F.lit(""))
            .when(r == 4, F.concat(F.lit("    async def h"), si, F.lit("(self):")))
            .when(r == 5, F.when(i % 2 == 1, F.lit('        """')).otherwise(F.concat(F.lit("        return "), w)))
            .otherwise(F.concat(F.lit("        "), t)))
    lines = d.select("output_id", F.col("i").cast("int").alias("line_no"), F.concat(code, F.lit("\n")).alias("line"))
    files = lines.groupBy("output_id").agg(F.count(F.lit(1)).alias("total_lines")).withColumn(
        "filename", F.concat(F.lit("doc"), F.col("output_id").cast("string"), F.lit(".py")))
    return lines, files


# ------------------------------------------------------------------- SQL

_DL = sql_lines("documents", "doc_id", "text", name="dl")
_WS = "[ \\t\\n\\r\\x0b\\f]"
_PYWS = "[\\s\\x0b\\x1c-\\x1f]"


def _pystrip(x: str) -> str:
    return f"regexp_replace({x}, '^{_PYWS}+|{_PYWS}+$', '', 'g')"


def _hint(x: str) -> str:
    c = f"trim(regexp_replace({x}, '{_PYWS}+', ' ', 'g'))"
    return f"(CASE WHEN length({c}) <= 80 THEN {c} ELSE rtrim(substr({c}, 1, 77)) || '...' END)"


_VIEW = """
_vsrc AS (
  SELECT output_id, line_no AS i, regexp_replace(line, '[\\n\\r]+$', '') AS t FROM dl
),
vlines AS (
  SELECT output_id, CAST(i + i // 3 AS INTEGER) AS line_no,
         CASE WHEN output_id % 4 = 0 AND i % 5 = 2 THEN '# ' || t ELSE t END || chr(10) AS line
  FROM _vsrc
  UNION ALL
  SELECT output_id, CAST(i + i // 3 + 1 AS INTEGER), chr(10) FROM _vsrc WHERE i % 3 = 2
),
vfiles AS (
  SELECT output_id, count(*) AS total_lines,
         'doc' || CAST(output_id AS VARCHAR) || CASE WHEN output_id % 4 = 0 THEN '.py' ELSE '.md' END AS filename
  FROM vlines GROUP BY output_id
)"""

_CODE = """
_csrc AS (
  SELECT output_id, line_no AS i, regexp_replace(line, '[\\n\\r]+$', '') AS t FROM dl
),
clines AS (
  SELECT output_id, CAST(i AS INTEGER) AS line_no, CASE i % 7
    WHEN 0 THEN CASE WHEN i % 28 = 0 THEN '@cached' WHEN i % 28 = 14 THEN 'class C' || CAST(i AS VARCHAR) || ':'
                     ELSE 'def f' || CAST(i AS VARCHAR) || '(x):' END
    WHEN 1 THEN CASE WHEN i % 28 = 1 THEN 'def g' || CAST(i AS VARCHAR) || '(y,' WHEN i % 28 = 15 THEN '    \"\"\"' || t
                     ELSE '    \"\"\"' || t || '\"\"\"' END
    WHEN 2 THEN CASE WHEN i % 28 = 2 THEN '        z):' ELSE '    # ' || t END
    WHEN 3 THEN ''
    WHEN 4 THEN '    async def h' || CAST(i AS VARCHAR) || '(self):'
    WHEN 5 THEN CASE WHEN i % 2 = 1 THEN '        \"\"\"' ELSE '        return ' || regexp_extract(t, '^(\\S*)', 1) END
    ELSE '        ' || t END || chr(10) AS line
  FROM _csrc
),
cfiles AS (
  SELECT output_id, count(*) AS total_lines, 'doc' || CAST(output_id AS VARCHAR) || '.py' AS filename
  FROM clines GROUP BY output_id
)"""


def _sql_view(src: str, files: str, limit: int = 100) -> str:
    return f"""
_vk AS (
  SELECT l.output_id, l.line_no, l.line, f.filename, f.total_lines,
         row_number() OVER (PARTITION BY l.output_id ORDER BY l.line_no) AS k,
         count(*) OVER (PARTITION BY l.output_id) AS nk
  FROM {src} l JOIN {files} f ON f.output_id = l.output_id
  WHERE regexp_replace(l.line, '^{_WS}+|{_WS}+$', '', 'g') <> ''
    AND NOT (ends_with(f.filename, '.py') AND starts_with(regexp_replace(l.line, '^{_WS}+|{_WS}+$', '', 'g'), '#'))
),
viewout AS (
  SELECT output_id, CAST(k - 1 AS BIGINT) AS seq, 'line' AS kind, line_no AS src_line_no, line, CAST(0 AS BIGINT) AS n_omitted
  FROM _vk WHERE k <= {limit}
  UNION ALL
  SELECT output_id, CAST(least(nk, {limit}) AS BIGINT), 'note', CAST(NULL AS INTEGER),
         chr(10) || '# linesift: ' || filename || ' has ' || CAST(total_lines AS VARCHAR) || ' lines total — for more: tail -n +'
         || CAST(least(nk, {limit}) + 1 AS VARCHAR) || ' ' || filename || ' | head -{limit}' || chr(10),
         CAST(total_lines - least(nk, {limit}) AS BIGINT)
  FROM _vk WHERE k = 1 AND total_lines > 0 AND least(nk, {limit}) >= {limit} AND total_lines > {limit}
)"""


def _sql_outline(src: str, files: str) -> str:
    strip = f"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')"
    return f"""
_o1 AS (
  SELECT *, {strip} AS s, length(line) - length(regexp_replace(line, '^{_WS}+', '')) AS ind,
         {_pystrip("regexp_replace(line, '[\\n\\r]+$', '')")} AS t
  FROM {src}
),
_o2 AS (
  SELECT *, starts_with(s, '@') AS dec,
         NOT starts_with(s, '@') AND (starts_with(s, 'class ') OR starts_with(s, 'def ') OR starts_with(s, 'async def ')) AS ent
  FROM _o1
),
_o3 AS (
  SELECT *, min(CASE WHEN NOT dec THEN CAST(line_no AS BIGINT) * 4 + CASE WHEN ent THEN 1 ELSE 2 END END)
              OVER (PARTITION BY output_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM _o2
),
_own AS (
  SELECT *, CASE WHEN ent THEN line_no WHEN dec AND nxt % 4 = 1 THEN nxt // 4 END AS owner FROM _o3
),
_ents AS (
  SELECT output_id, line_no AS e_no, line AS e_line, ind AS base,
         NOT ends_with(regexp_replace(line, '{_WS}+$', ''), ':') AS sig0
  FROM _own WHERE ent
),
_fol AS (
  SELECT e.*, o.line_no - e.e_no AS d, o.s, o.ind, o.t
  FROM _ents e JOIN _o1 o ON o.output_id = e.output_id AND o.line_no > e.e_no AND o.line_no <= e.e_no + 23
),
_sc AS (
  SELECT output_id, e_no, min(d) FILTER (WHERE d <= 12 AND s <> '' AND ends_with(s, ':')) AS sc FROM _fol GROUP BY output_id, e_no
),
_dec1 AS (
  SELECT f.output_id, f.e_no,
         arg_min(f.d, f.d) FILTER (WHERE f.d <= 12 AND f.s <> '' AND f.d > CASE WHEN f.sig0 THEN coalesce(c.sc, 99) ELSE 0 END
                                   AND (f.ind <= f.base OR NOT (starts_with(f.s, '#') OR starts_with(f.s, '@')))) AS dpos
  FROM _fol f JOIN _sc c ON c.output_id = f.output_id AND c.e_no = f.e_no
  GROUP BY f.output_id, f.e_no
),
_dec2 AS (
  SELECT x.output_id, x.e_no, x.dpos, f.t AS ft, f.ind AS find, f.base
  FROM _dec1 x JOIN _fol f ON f.output_id = x.output_id AND f.e_no = x.e_no AND f.d = x.dpos
  WHERE f.ind > f.base
),
_dec3 AS (
  SELECT *, regexp_matches(ft, '^([rRuUbBfF]*)([\"'']{{3}}|[\"''])') AS isdoc,
         regexp_extract(ft, '^([rRuUbBfF]*)([\"'']{{3}}|[\"''])', 1) AS pre,
         regexp_extract(ft, '^([rRuUbBfF]*)([\"'']{{3}}|[\"''])', 2) AS delim
  FROM _dec2
),
_dec4 AS (
  SELECT *, substr(ft, length(pre) + length(delim) + 1) AS rem FROM _dec3
),
_dec5 AS (
  SELECT *, CASE WHEN rem = '' THEN ''
                 ELSE {_pystrip("CASE WHEN strpos(rem, delim) > 0 THEN substr(rem, 1, strpos(rem, delim) - 1) ELSE rem END")}
            END AS same
  FROM _dec4
),
_later AS (
  SELECT x.output_id, x.e_no,
         arg_min(CASE WHEN tx <> '' THEN tx END, f.d) FILTER (WHERE tx <> '' OR f.ind <= x.base) AS lt,
         bool_or(true) FILTER (WHERE tx <> '' OR f.ind <= x.base) AS hit
  FROM _dec5 x JOIN (
    SELECT *, {_pystrip("CASE WHEN strpos(t, delim2) > 0 THEN substr(t, 1, strpos(t, delim2) - 1) ELSE t END")} AS tx
    FROM (SELECT f.*, d5.delim AS delim2 FROM _fol f JOIN _dec5 d5 ON d5.output_id = f.output_id AND d5.e_no = f.e_no) ff
  ) f ON f.output_id = x.output_id AND f.e_no = x.e_no AND f.d > x.dpos AND f.d < x.dpos + 12
  WHERE x.isdoc
  GROUP BY x.output_id, x.e_no
),
_hints AS (
  SELECT d.output_id, d.e_no,
         CASE WHEN NOT d.isdoc THEN {_hint('d.ft')}
              WHEN d.same <> '' THEN 'doc: ' || {_hint('d.same')}
              WHEN l.lt IS NOT NULL THEN 'doc: ' || {_hint('l.lt')}
              ELSE 'docstring' END AS hint
  FROM _dec5 d LEFT JOIN _later l ON l.output_id = d.output_id AND l.e_no = d.e_no
),
_orows AS (
  SELECT o.output_id, o.line_no, o.line, h.hint, e.ind AS oind
  FROM _own o JOIN _o1 e ON e.output_id = o.output_id AND e.line_no = o.owner
  LEFT JOIN _hints h ON h.output_id = o.output_id AND h.e_no = o.line_no AND o.ent
  WHERE o.owner IS NOT NULL
),
_orows2 AS (
  SELECT output_id, line_no,
         '  L' || CAST(line_no + 1 AS VARCHAR) || ': ' || CASE WHEN oind > 0 THEN repeat('    ', oind // 4) ELSE '' END
         || regexp_replace(regexp_replace(line, '[\\n\\r]+$', ''), '^{_PYWS}+', '')
         || CASE WHEN hint IS NOT NULL THEN '  # ' || hint ELSE '' END || chr(10) AS text,
         row_number() OVER (PARTITION BY output_id ORDER BY line_no) AS k
  FROM _orows
),
_ocnt AS (SELECT output_id, count(*) AS n FROM _orows2 GROUP BY output_id),
outlineout AS (
  SELECT output_id, CAST(k AS BIGINT) AS seq, 'line' AS kind, line_no AS src_line_no, text AS line, CAST(0 AS BIGINT) AS n_omitted
  FROM _orows2
  UNION ALL
  SELECT f.output_id, CAST(0 AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# linesift: Python outline for ' || f.filename || ' (' || CAST(f.total_lines AS VARCHAR) || ' lines)' || chr(10), CAST(0 AS BIGINT)
  FROM {files} f
  UNION ALL
  SELECT f.output_id, CAST(coalesce(c.n, 0) + 1 AS BIGINT), 'note', CAST(NULL AS INTEGER),
         chr(10) || '# To read a section: sed -n ''START,ENDp'' ' || f.filename || chr(10), CAST(0 AS BIGINT)
  FROM {files} f LEFT JOIN _ocnt c ON c.output_id = f.output_id
)"""


@register("outline_index", with_ctes(_DL, _CODE, _sql_outline("clines", "cfiles")) + """
SELECT * FROM outlineout""")
def outline_index(spark, sf_dir):
    """T13 + T14 on every document rendered as Python code."""
    lines, files = code_lines(spark, sf_dir)
    return outline(lines, files)


@register("document_view", with_ctes(_DL, _VIEW, """
_big AS (SELECT * FROM vfiles WHERE ends_with(filename, '.py') AND total_lines > 100),
_small AS (SELECT * FROM vfiles WHERE NOT (ends_with(filename, '.py') AND total_lines > 100)),
_bl AS (SELECT l.* FROM vlines l JOIN _big b ON b.output_id = l.output_id),
_sl AS (SELECT l.* FROM vlines l JOIN _small b ON b.output_id = l.output_id)""",
                                     _sql_view("_sl", "_small"), _sql_outline("_bl", "_big")) + """
SELECT * FROM viewout UNION ALL SELECT * FROM outlineout""")
def document_view_q(spark, sf_dir):
    """Cat strategy: T13/T14 for .py files over 100 lines, else T12."""
    lines, files = view_files(spark, sf_dir)
    big = (F.col("filename").endswith(".py")) & (F.col("total_lines") > OUTLINE_THRESHOLD)
    bf, sf = files.where(big), files.where(~big)
    bl = lines.join(bf.select("output_id"), "output_id")
    sl = lines.join(sf.select("output_id"), "output_id")
    return document_view(sl, sf).unionByName(outline(bl, bf))


@register("document_view_short", with_ctes(_DL, _VIEW, _sql_view("vlines", "vfiles", 10)) + """
SELECT * FROM viewout""")
def document_view_short(spark, sf_dir):
    """T12 at 10 lines, which many documents pass."""
    lines, files = view_files(spark, sf_dir)
    return document_view(lines, files, limit=10)


@register("document_resume_points", with_ctes(_DL, _VIEW, _sql_view("vlines", "vfiles")) + """
SELECT output_id, CAST(max(src_line_no) + 2 AS BIGINT) AS resume_line_no FROM viewout
WHERE kind = 'line' AND output_id IN (SELECT output_id FROM viewout WHERE kind = 'note')
GROUP BY output_id""")
def document_resume_points_q(spark, sf_dir):
    """T12 QUIRK 6: the correct resume line of every cut document view."""
    from ..operators.document import resume_points
    lines, files = view_files(spark, sf_dir)
    return resume_points(document_view(lines, files))
