"""Registered version-control queries.

Log outputs: one ``git log`` per customer, one entry per order (by order key):
``commit <md5(orderkey)>``, author, date, blank, message, blank, then one stat
line per lineitem.  Customers with key mod 3 = 1 get graph decoration
(``* `` on entry starts, ``| `` elsewhere); key mod 3 = 2 get the one-line
format ``<first 12 of md5> order <key>``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.scan import CHUNK_COL, segmented_scan
from ..operators.vcs import cap_log_entries, classify_vcs
from .catalog import register, sql_lines, with_ctes
from .inputs import document_outputs, table
from ..operators.lines import to_lines


def log_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    wi = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = li.withColumn("k", F.row_number().over(wi) + 5)
    n_items = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    fmt = (F.col("o_custkey") % 3).cast("int")
    o = o.join(n_items, o.o_orderkey == n_items.l_orderkey, "left").drop("l_orderkey").withColumn("fmt", fmt)
    size = F.when(F.col("fmt") == 2, F.lit(1)).otherwise(6 + F.coalesce("n_items", F.lit(0)))
    o = segmented_scan(o.withColumn("_size", size), ["o_custkey"], "o_orderkey",
                       running_sum={"_end": F.col("_size")}).drop(CHUNK_COL)
    o = o.withColumn("_start", F.col("_end") - F.col("_size"))
    sha = F.md5(F.col("o_orderkey").cast("string"))
    head = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("commit "), sha).alias("t")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("Author: Customer "), F.col("o_custkey").cast("string")).alias("t")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("Date:   "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t")),
        F.struct(F.lit(3).alias("k"), F.lit("").alias("t")),
        F.struct(F.lit(4).alias("k"), F.concat(F.lit("    order "), F.col("o_orderkey").cast("string"), F.lit(" "),
                                               F.col("o_orderstatus")).alias("t")),
        F.struct(F.lit(5).alias("k"), F.lit("").alias("t")))
    one = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.substring(sha, 1, 12), F.lit(" order "),
                                                         F.col("o_orderkey").cast("string")).alias("t")))
    hl = o.select("o_custkey", "o_orderkey", "_start", "fmt",
                  F.explode(F.when(F.col("fmt") == 2, one).otherwise(head)).alias("e")).select(
        "o_custkey", "_start", "fmt", "o_orderkey", F.col("e.k").alias("k"), F.col("e.t").alias("t"))
    il = (items.join(o.where(F.col("fmt") != 2).select("o_orderkey", "o_custkey", "_start", "fmt"),
                     items.l_orderkey == F.col("o_orderkey"))
          .select("o_custkey", "_start", "fmt", "o_orderkey", "k",
                  F.concat(F.lit(" part"), F.col("l_partkey").cast("string"), F.lit(" | "),
                           F.col("l_quantity").cast("int").cast("string"), F.lit(" "),
                           F.repeat(F.lit("+"), (F.floor(F.col("l_quantity") / 10) + 1).cast("int"))).alias("t")))
    allr = hl.unionByName(il)
    deco = (F.when(F.col("fmt") != 1, F.lit("")).when(F.col("k") == 0, F.lit("* ")).otherwise(F.lit("| ")))
    return allr.select(F.col("o_custkey").alias("output_id"), (F.col("_start") + F.col("k")).cast("int").alias("line_no"),
                       F.concat(deco, F.col("t"), F.lit("\n")).alias("line"))


_SQL_LOG = """
_items AS (
  SELECT l_orderkey, l_partkey, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) + 5 AS k
  FROM lineitem
),
_n AS (SELECT l_orderkey, count(*) AS n_items FROM _items GROUP BY l_orderkey),
_o AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus, CAST(o.o_custkey % 3 AS INTEGER) AS fmt,
         CASE WHEN o.o_custkey % 3 = 2 THEN 1 ELSE 6 + coalesce(n.n_items, 0) END AS size
  FROM orders o LEFT JOIN _n n ON n.l_orderkey = o.o_orderkey
),
_os AS (
  SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - size AS start
  FROM _o
),
_ent AS (
  SELECT o_custkey, start, fmt, 0 AS k, CASE WHEN fmt = 2 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) || ' order ' || CAST(o_orderkey AS VARCHAR)
                                       ELSE 'commit ' || md5(CAST(o_orderkey AS VARCHAR)) END AS t FROM _os
  UNION ALL SELECT o_custkey, start, fmt, 1, 'Author: Customer ' || CAST(o_custkey AS VARCHAR) FROM _os WHERE fmt <> 2
  UNION ALL SELECT o_custkey, start, fmt, 2, 'Date:   ' || strftime(o_orderdate, '%Y-%m-%d') FROM _os WHERE fmt <> 2
  UNION ALL SELECT o_custkey, start, fmt, 3, '' FROM _os WHERE fmt <> 2
  UNION ALL SELECT o_custkey, start, fmt, 4, '    order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus FROM _os WHERE fmt <> 2
  UNION ALL SELECT o_custkey, start, fmt, 5, '' FROM _os WHERE fmt <> 2
  UNION ALL SELECT s.o_custkey, s.start, s.fmt, i.k, ' part' || CAST(i.l_partkey AS VARCHAR) || ' | '
                   || CAST(CAST(trunc(i.l_quantity) AS INTEGER) AS VARCHAR) || ' ' || repeat('+', CAST(floor(i.l_quantity / 10) + 1 AS INTEGER))
            FROM _os s JOIN _items i ON i.l_orderkey = s.o_orderkey WHERE s.fmt <> 2
),
loglines AS (
  SELECT o_custkey AS output_id, CAST(start + k AS INTEGER) AS line_no,
         CASE WHEN fmt <> 1 THEN '' WHEN k = 0 THEN '* ' ELSE '| ' END || t || chr(10) AS line
  FROM _ent
)"""

_WS = "[ \\t\\n\\r\\x0b\\f]"


def _sql_cap_log(src: str, max_entries: int = 20) -> str:
    return f"""
_lg AS (
  SELECT *, regexp_replace(line, '^[*|/\\\\ ]+', '') AS s FROM {src}
),
_lg2 AS (
  SELECT *, regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g') <> '' AS nonblank,
         regexp_matches(s, '^commit [0-9a-f]{{7,40}}') AS is_std, regexp_matches(s, '^[0-9a-f]{{7,40}} ') AS is_one,
         line_no < 15 AND regexp_matches(line, '^[*|/\\\\ ]')
           AND regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') <> ''
           AND NOT starts_with(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), 'commit ') AS g
  FROM _lg
),
_fmt AS (
  SELECT output_id, arg_min(is_std, line_no) FILTER (WHERE nonblank) AS f_std,
         arg_min(is_one, line_no) FILTER (WHERE nonblank) AS f_one, bool_or(g) AS graph
  FROM _lg2 GROUP BY output_id
),
_lg3 AS (
  SELECT l.*, f.f_std, f.f_one AND NOT f.f_std AS one, f.graph,
         sum(CASE WHEN (f.f_one AND NOT f.f_std AND f.graph AND l.is_one) OR (NOT (f.f_one AND NOT f.f_std AND f.graph) AND l.is_std)
                  THEN 1 ELSE 0 END) OVER (PARTITION BY l.output_id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING) AS entries
  FROM _lg2 l JOIN _fmt f ON f.output_id = l.output_id
),
capped AS (
  SELECT output_id, CAST(line_no AS BIGINT) AS seq, 'line' AS kind, line_no AS src_line_no, line, CAST(0 AS BIGINT) AS n_omitted
  FROM _lg3
  WHERE f_std IS NULL OR (CASE WHEN one AND NOT graph THEN line_no < {max_entries} ELSE entries <= {max_entries} END)
)"""


@register("log_entry_cap", with_ctes(_SQL_LOG, _sql_cap_log("loglines")) + """
SELECT * FROM capped""")
def log_entry_cap(spark, sf_dir):
    """T6 on every customer's derived commit log."""
    return cap_log_entries(log_lines(spark, sf_dir))


# ------------------------------------------------------------------ diffs

def _change_prefix(i):
    return F.when(i % 9 == 4, F.lit("+")).when(i % 13 == 7, F.lit("-")).otherwise(F.lit(" "))


def diff_lines(spark, sf_dir):
    """One diff per document source; one file per document (by doc id): git
    header, index line, ---/+++ headers, one hunk whose body is the document's
    lines prefixed '+' (line i mod 9 = 4), '-' (i mod 13 = 7) or ' ', plus a
    '\\ No newline' row for doc ids divisible by 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = to_lines(document_outputs(spark, sf_dir)).withColumnRenamed("output_id", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    blk = docs.join(n, "doc_id").withColumn("nonl", F.col("doc_id") % 7 == 0)
    blk = blk.withColumn("_size", 5 + F.col("n") + F.col("nonl").cast("int"))
    blk = segmented_scan(blk, ["source"], "doc_id", running_sum={"_end": F.col("_size")}).drop(CHUNK_COL)
    blk = blk.withColumn("start", F.col("_end") - F.col("_size"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    sha = F.md5(F.col("doc_id").cast("string"))
    head = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name).alias("t")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("index "), F.substring(sha, 1, 7), F.lit(".."),
                                               F.substring(sha, 8, 7), F.lit(" 100644")).alias("t")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("--- a/"), name).alias("t")),
        F.struct(F.lit(3).alias("k"), F.concat(F.lit("+++ b/"), name).alias("t")),
        F.struct(F.lit(4).alias("k"), F.concat(F.lit("@@ -1,"), F.col("n").cast("string"), F.lit(" +"),
                                               (F.col("doc_id") % 50 + 1).cast("string"), F.lit(","),
                                               F.col("n").cast("string"), F.lit(" @@")).alias("t")))
    hl = blk.select("source", "start", F.explode(head).alias("e")).select("source", "start", "e.k", "e.t")
    nl = blk.where("nonl").select("source", "start", (5 + F.col("n")).alias("k"),
                                  F.lit("\\ No newline at end of file").alias("t"))
    # whole texts are shuffled to their place in the diff, not their lines
    texts = document_outputs(spark, sf_dir).select(F.col("output_id").alias("doc_id"), "stdout")
    placed = texts.join(blk.select("doc_id", "source", "start"), "doc_id")
    bl = to_lines(placed, key="doc_id", keep=("source", "start")).select(
        "source", "start", (5 + F.col("line_no")).alias("k"),
        F.concat(_change_prefix(F.col("line_no")), F.regexp_replace("line", "\\n$", "")).alias("t"))
    allr = hl.unionByName(nl).unionByName(bl)
    return allr.select(F.col("source").alias("output_id"), (F.col("start") + F.col("k")).cast("int").alias("line_no"),
                       F.concat(F.col("t"), F.lit("\n")).alias("line"))


_SQL_DIFF = sql_lines("documents", "doc_id", "text", name="dl") + """,
_nd AS (SELECT output_id AS doc_id, count(*) AS n FROM dl GROUP BY output_id),
_blk AS (
  SELECT d.doc_id, d.source, n.n, d.doc_id % 7 = 0 AS nonl, 5 + n.n + CASE WHEN d.doc_id % 7 = 0 THEN 1 ELSE 0 END AS size
  FROM documents d JOIN _nd n ON n.doc_id = d.doc_id
),
_pos AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM _blk),
_dt AS (
  SELECT source, start, 0 AS k, 'diff --git a/doc' || CAST(doc_id AS VARCHAR) || '.txt b/doc' || CAST(doc_id AS VARCHAR) || '.txt' AS t FROM _pos
  UNION ALL SELECT source, start, 1, 'index ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) || '..' || substr(md5(CAST(doc_id AS VARCHAR)), 8, 7) || ' 100644' FROM _pos
  UNION ALL SELECT source, start, 2, '--- a/doc' || CAST(doc_id AS VARCHAR) || '.txt' FROM _pos
  UNION ALL SELECT source, start, 3, '+++ b/doc' || CAST(doc_id AS VARCHAR) || '.txt' FROM _pos
  UNION ALL SELECT source, start, 4, '@@ -1,' || CAST(n AS VARCHAR) || ' +' || CAST(doc_id % 50 + 1 AS VARCHAR) || ',' || CAST(n AS VARCHAR) || ' @@' FROM _pos
  UNION ALL SELECT source, start, 5 + n, '\\ No newline at end of file' FROM _pos WHERE nonl
  UNION ALL SELECT p.source, p.start, 5 + l.line_no,
         CASE WHEN l.line_no % 9 = 4 THEN '+' WHEN l.line_no % 13 = 7 THEN '-' ELSE ' ' END || regexp_replace(l.line, '\\n$', '')
  FROM _pos p JOIN dl l ON l.output_id = p.doc_id
),
difflines AS (SELECT source AS output_id, CAST(start + k AS INTEGER) AS line_no, t || chr(10) AS line FROM _dt)"""


def _sql_compact_diff(src: str) -> str:
    hh_re = "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@"
    return f"""
_d AS (
  SELECT output_id, line_no, line, starts_with(line, 'index ') AND contains(line, '..') AS drp FROM {src}
),
_d1 AS (
  SELECT *, NOT drp AND starts_with(line, '@@') AS hh,
         NOT drp AND NOT starts_with(line, '@@') AND starts_with(line, 'diff --git') AS dg
  FROM _d
),
_d2 AS (
  SELECT *, max(CASE WHEN hh THEN CAST(line_no AS BIGINT) * 2 + 1 WHEN dg THEN CAST(line_no AS BIGINT) * 2 END)
              OVER (PARTITION BY output_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS lastm,
         sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY output_id) AS files
  FROM _d1
),
_d3 AS (
  SELECT *, coalesce(lastm % 2 = 1, false) AS inh,
         NOT drp AND NOT hh AND NOT dg AND coalesce(lastm % 2 = 1, false) AS body,
         CASE WHEN lastm % 2 = 1 THEN lastm // 2 END AS hunk
  FROM _d2
),
_heads AS (
  SELECT output_id, CAST(line_no AS BIGINT) AS hunk,
         CAST(nullif(regexp_extract(line, '{hh_re}', 1), '') AS BIGINT) AS ns
  FROM _d3 WHERE hh
),
_b AS (
  SELECT b.output_id, b.hunk, b.line_no, b.line, h.ns,
         row_number() OVER wh - 1 AS bi, count(*) OVER (PARTITION BY b.output_id, b.hunk) AS nb,
         starts_with(b.line, '+') OR starts_with(b.line, '-') OR starts_with(b.line, '\\ ')
           OR coalesce(lead(starts_with(b.line, '\\ ')) OVER wh, false) AS intr,
         CASE WHEN starts_with(b.line, '-') THEN 0 ELSE 1 END AS adv
  FROM _d3 b LEFT JOIN _heads h ON h.output_id = b.output_id AND h.hunk = b.hunk
  WHERE b.body
  WINDOW wh AS (PARTITION BY b.output_id, b.hunk ORDER BY b.line_no)
),
_b2 AS (
  SELECT *, max(CASE WHEN intr THEN bi END) OVER (PARTITION BY output_id, hunk ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS li,
         min(CASE WHEN intr THEN bi END) OVER (PARTITION BY output_id, hunk ORDER BY line_no
                                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
         max(CASE WHEN intr THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, hunk) AS anyi,
         coalesce(sum(adv) OVER (PARTITION BY output_id, hunk ORDER BY line_no
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newb
  FROM _b
),
_b3 AS (SELECT *, coalesce(bi - li <= 3 OR ni - bi <= 3, false) AS kept FROM _b2),
_b4 AS (
  SELECT *, min(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, hunk) AS allkept,
         sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, hunk ORDER BY line_no ROWS UNBOUNDED PRECEDING)
           AS island
  FROM _b3
),
_b5 AS (
  SELECT *, nb > 20 AND anyi = 1 AND allkept = 0 AS comp,
         sum(CASE WHEN NOT kept THEN 1 ELSE 0 END) OVER g AS glen,
         min(CASE WHEN NOT kept THEN CASE WHEN starts_with(line, ' ') THEN 1 ELSE 0 END END) OVER g AS gspace,
         min(CASE WHEN NOT kept THEN line_no END) OVER g AS gfirst
  FROM _b4 WINDOW g AS (PARTITION BY output_id, hunk, island)
),
_rows AS (
  SELECT output_id, line_no, 'line' AS kind, line, CAST(0 AS BIGINT) AS n_omitted FROM _b5 WHERE NOT comp OR kept OR gspace = 0
  UNION ALL
  SELECT output_id, line_no, 'note', '... (' || CAST(glen AS VARCHAR) || ' lines omitted'
         || CASE WHEN ns IS NOT NULL THEN ', lines ' || CAST(ns + newb AS VARCHAR) || '-' || CAST(ns + newb + glen - 1 AS VARCHAR)
                 ELSE '' END || ')' || chr(10), CAST(glen AS BIGINT)
  FROM _b5 WHERE comp AND NOT kept AND gspace = 1 AND line_no = gfirst
  UNION ALL
  SELECT output_id, line_no, 'line', line, CAST(0 AS BIGINT) FROM _d3
  WHERE NOT body AND NOT drp AND NOT (files > 3 AND NOT inh AND (starts_with(line, '--- ') OR starts_with(line, '+++ ')))
),
_files AS (SELECT DISTINCT output_id, files FROM _d2),
diffout AS (
  SELECT r.output_id,
         CAST(row_number() OVER (PARTITION BY r.output_id ORDER BY r.line_no) - 1 + CASE WHEN f.files > 3 THEN 1 ELSE 0 END AS BIGINT) AS seq,
         r.kind, r.line_no AS src_line_no, r.line, r.n_omitted
  FROM _rows r JOIN _files f ON f.output_id = r.output_id
  UNION ALL
  SELECT output_id, CAST(0 AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# linesift: ' || CAST(files AS VARCHAR) || ' files changed — file headers compressed' || chr(10), CAST(files AS BIGINT)
  FROM _files WHERE files > 3
)"""


@register("diff_context", with_ctes(_SQL_DIFF, _sql_compact_diff("difflines")) + """
SELECT * FROM diffout""")
def diff_context(spark, sf_dir):
    """T10 + T11 on the per-source diffs."""
    from ..operators.vcs import compact_diff
    return compact_diff(diff_lines(spark, sf_dir))


@register("vcs_shape", with_ctes(_SQL_LOG, _SQL_DIFF, sql_lines("documents", "doc_id", "text", name="docl"), """
_all AS (
  SELECT 'log-' || CAST(output_id AS VARCHAR) AS output_id, line_no, line FROM loglines
  UNION ALL SELECT 'diff-' || output_id, line_no, line FROM difflines
  UNION ALL SELECT 'doc-' || CAST(output_id AS VARCHAR), line_no, line FROM docl
)""") + """
SELECT output_id, CASE WHEN bool_or(line_no < 20 AND (starts_with(line, 'diff --git') OR starts_with(line, '--- '))) THEN 'diff'
                       WHEN bool_or(line_no < 10 AND (regexp_matches(regexp_replace(line, '^[*|/\\\\ ]+', ''), '^commit [0-9a-f]{7,40}')
                                                      OR regexp_matches(regexp_replace(line, '^[*|/\\\\ ]+', ''), '^[0-9a-f]{7,40} ')))
                       THEN 'log' ELSE 'other' END AS shape
FROM _all WHERE line_no < 20 GROUP BY output_id""")
def vcs_shape(spark, sf_dir):
    """T5 over logs, diffs and plain documents together."""
    allr = (log_lines(spark, sf_dir).select(F.concat(F.lit("log-"), F.col("output_id").cast("string")).alias("output_id"),
                                            "line_no", "line")
            .unionByName(diff_lines(spark, sf_dir).select(F.concat(F.lit("diff-"), "output_id").alias("output_id"),
                                                          "line_no", "line"))
            .unionByName(to_lines(document_outputs(spark, sf_dir)).select(
                F.concat(F.lit("doc-"), F.col("output_id").cast("string")).alias("output_id"), "line_no", "line")))
    return classify_vcs(allr)
