"""Registered dispatch queries (T0, E2, T15, T16 end to end).

``compact_all`` puts every derived family into one outputs table and lets the
dispatcher route them: ``cat`` (document files), ``rg`` (search outputs; those
of doc ids divisible by 11 were run with the bypass flag), ``git`` (logs and
diffs, told apart by T5), ``ls`` / ``/usr/bin/find`` (listings) and ``curl``
(page HTML, every 10th page prefixed with a NUL byte and so binary).  The
result is the savings report by command over the T16 facts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dispatch import compact, compacted_sizes, line_metrics, outputs_to_lines
from ..operators.lines import binary_flag
from ..operators.scan import cut_parts
from ..operators.usage import savings_by_command
from ..session import ensure_checkpoint_dir
from . import documents, listing, search, vcs
from .catalog import ORACLE, register, rounded, sql_collapse, sql_effective, sql_lines, sql_savings_cols, with_ctes
from .inputs import table


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    nul = (F.col("page_id") % 10) == 0
    return p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("output_id"),
                    "page_id", F.lit("curl").alias("command"), F.array("url").alias("args"),
                    F.concat(F.when(nul, F.lit("\u0000")).otherwise(F.lit("")), F.col("html")).alias("stdout"))


@register("binary_flag", """
WITH _pg AS (
  SELECT page_id, CASE WHEN page_id % 10 = 0 THEN from_hex('00') || encode(html) ELSE encode(html) END AS blob FROM pages
),
_hx AS (SELECT page_id, substr(hex(blob), 1, 8192) AS hx FROM _pg)
SELECT page_id,
       CASE WHEN hx = '' THEN false
            WHEN regexp_matches(hx, '^(..)*?00') THEN true
            WHEN try(decode(from_hex(hx))) IS NOT NULL THEN false
            ELSE length(regexp_replace(regexp_replace(hx, '(..)', '\\1 ', 'g'),
                                       '(09|0A|0C|0D|2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]) ', '', 'g')) / 3.0
                 / (length(hx) / 2.0) > 0.30 END AS is_binary
FROM _hx""")
def binary_flag_q(spark, sf_dir):
    """E2 on every page (bytes of the UTF-8 text, NUL-prefixed for every 10th page)."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", binary_flag(p).alias("is_binary"))


def families(spark, sf_dir):
    """Every derived family as a line table with per-line command metadata, as calls
    that build them."""
    def fam(lines, prefix, command, args, full=F.lit(False)):
        return lines.select(F.concat(F.lit(prefix), F.col("output_id").cast("string")).alias("output_id"),
                            "line_no", "line", F.lit(command).alias("command"), args.alias("args"),
                            full.alias("full"), F.lit(False).alias("binary"))

    def cat():
        vl, vf = documents.view_files(spark, sf_dir)
        return fam(vl.join(vf.select("output_id", "filename"), "output_id"), "doc-", "cat", F.array("filename"))

    def ls():
        return listing.listing_lines(spark, sf_dir).select(
            F.concat(F.lit("ls-"), "output_id").alias("output_id"), "line_no", "line",
            F.when(F.col("output_id").startswith("pages-"), F.lit("ls")).otherwise(F.lit("/usr/bin/find")).alias("command"),
            F.array(F.lit(".")).alias("args"), F.lit(False).alias("full"), F.lit(False).alias("binary"))

    return [
        cat,
        lambda: fam(search.search_output_lines(spark, sf_dir), "rg-", "rg", F.array(F.lit("-C2"), F.lit("the")),
                    (F.col("output_id") % 11) == 0),
        lambda: fam(vcs.log_lines(spark, sf_dir), "log-", "git", F.array(F.lit("log"))),
        lambda: fam(vcs.diff_lines(spark, sf_dir), "diff-", "git", F.array(F.lit("diff"))),
        ls,
        lambda: outputs_to_lines(_pages(spark, sf_dir).drop("page_id")).select(
            "output_id", "line_no", "line", "command", "args", "full", "binary"),
    ]


def all_lines(spark, sf_dir):
    """Every derived family in one line table, derived one after another."""
    return cut_parts(spark, families(spark, sf_dir))


def _fam_sql(prefix: str, command: str, raw: str, out: str, full: str = "false", binary: str = "false") -> str:
    return f"""
  SELECT {command} AS command, r.line_count, r.stdout_lines, r.stdout_bytes,
         CASE WHEN {full} OR {binary} THEN r.line_count ELSE coalesce(o.lines_out, 0) END AS lines_out, {full} AS "full"
  FROM ({raw}) r LEFT JOIN ({out}) o ON o.output_id = r.output_id"""


def _raw(ctes: str, src: str) -> str:
    return ctes + f"""
SELECT output_id, count(*) AS line_count, count(*) FILTER (WHERE ends_with(line, chr(10))) AS stdout_lines,
       sum(strlen(line)) AS stdout_bytes FROM {src} GROUP BY output_id"""


def _out(sql: str) -> str:
    return f"SELECT output_id, count(*) AS lines_out FROM ({sql}) GROUP BY output_id"


def _compact_all_sql() -> str:
    html = with_ctes(sql_lines("pages", "page_id", "html"), sql_collapse(200))
    pages_raw = html + """
SELECT output_id, count(*) AS line_count, count(*) FILTER (WHERE ends_with(line, chr(10))) AS stdout_lines,
       sum(strlen(line)) + CASE WHEN output_id % 10 = 0 THEN 1 ELSE 0 END AS stdout_bytes FROM lines GROUP BY output_id"""
    pages_out = html + "\nSELECT output_id, count(*) AS lines_out FROM compacted GROUP BY output_id"
    e2 = ORACLE["binary_flag"]
    fams = [
        _fam_sql("doc-", "'cat'", _raw(with_ctes(documents._DL, documents._VIEW), "vlines"), _out(ORACLE["document_view"])),
        _fam_sql("rg-", "'rg'", _raw(search._SQL, "rg"), _out(ORACLE["search_hits"]), "r.output_id % 11 = 0"),
        _fam_sql("log-", "'git'", _raw(with_ctes(vcs._SQL_LOG), "loglines"), _out(ORACLE["log_entry_cap"])),
        _fam_sql("diff-", "'git'", _raw(with_ctes(vcs._SQL_DIFF), "difflines"), _out(ORACLE["diff_context"])),
        _fam_sql("ls-", "CASE WHEN starts_with(r.output_id, 'pages-') THEN 'ls' ELSE '/usr/bin/find' END",
                 _raw(with_ctes(listing._SQL_LISTING), "lst"), _out(ORACLE["listing_sample"])),
        _fam_sql("page-", "'curl'", pages_raw, pages_out, "false",
                 f"(SELECT is_binary FROM ({e2}) b WHERE b.page_id = r.output_id)"),
    ]
    return "WITH fam AS (" + "\n  UNION ALL".join(fams) + """
),
inv AS (
  SELECT command, CAST(stdout_lines AS BIGINT) AS stdout_lines, CAST(stdout_bytes AS BIGINT) AS stdout_bytes,
         CASE WHEN NOT "full" AND lines_out <> line_count THEN CAST(lines_out AS BIGINT) END AS compressed_lines,
         "full"
  FROM fam
),""" + sql_effective("inv").strip("\n") + f"""
SELECT command, {sql_savings_cols()} FROM eff2 GROUP BY command"""


@register("compact_all", _compact_all_sql())
def compact_all(spark, sf_dir):
    """T0 + T15 + T16 + A7: every family through the dispatcher, savings by command.
    (Bypassed outputs count as full calls; binary pages pass through unchanged.)"""
    ensure_checkpoint_dir(spark)
    # The derived families are costly and every strategy reads its slice of them:
    # written once, as a compressed table by column.  Of the compacted rows only the
    # sizes are kept, strategy by strategy.
    lines = all_lines(spark, sf_dir)
    compacted = compact(lines, each=compacted_sizes)
    facts = line_metrics(lines, compacted)
    return rounded(savings_by_command(facts.select("command", "stdout_lines", "stdout_bytes", "compressed_lines",
                                                   "full", F.lit(None).cast("string").alias("session_id"))))


@register("binary_output_bytes", with_ctes(sql_lines("pages", "page_id", "html"), sql_collapse(200)) + """
SELECT page_id AS output_id, CAST(n AS BIGINT) AS stdout_bytes, CAST(CASE WHEN page_id % 2 = 0 THEN n ELSE m END AS BIGINT) AS bytes_out,
       page_id % 2 = 0 AS "full"
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 0 ELSE strlen(html) END AS n,
             CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 0 ELSE coalesce(b, 0) END AS m
      FROM pages LEFT JOIN (SELECT output_id, sum(strlen(line)) AS b FROM compacted GROUP BY output_id) c ON c.output_id = page_id)""")
def binary_output_bytes(spark, sf_dir):
    """T0 + T15 + T16 on outputs that come as bytes, some empty and some missing: every
    call has its facts; bypassed outputs come out byte for byte, the others with the
    bytes of their compacted lines."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("output_id"), F.lit("curl").alias("command"), (F.col("page_id") % 2 == 0).alias("full"),
        F.when(F.col("page_id") % 7 == 0, F.lit(b"")).when(F.col("page_id") % 11 != 0, F.encode("html", "UTF-8")).alias("stdout"))
    lines = outputs_to_lines(pages)
    return line_metrics(lines, compact(lines), pages).select("output_id", "stdout_bytes", "bytes_out", "full")
