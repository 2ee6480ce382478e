"""Raw vs compacted comparison (B1, B2).

The compacted output as a reader sees it is the header line (when E13 shows
it) followed by the compacted rows.  Lines are counted as newline bytes, as the
comparison in the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import newline_count

# Neutral marker put before every note this library writes.
DEFAULT_MARKER = "# linesift:"


def header_text(lines_in, lines_out, marker: str = DEFAULT_MARKER):
    """E13 header: ``<marker> N → M lines``."""
    return F.concat(F.lit(marker + " "), lines_in.cast("string"), F.lit(" → "), lines_out.cast("string"),
                    F.lit(" lines\n"))


def rendered_facts(compacted: DataFrame, metrics: DataFrame, key: str = "output_id",
                   marker: str = DEFAULT_MARKER) -> DataFrame:
    """Per output: newline count and bytes of header + compacted rows."""
    body = compacted.groupBy(F.col(key).alias("output_id")).agg(
        F.sum(newline_count(F.col("line"))).cast("long").alias("_bl"),
        F.sum(F.octet_length("line")).cast("long").alias("_bb"))
    d = metrics.select("output_id", "line_count", "lines_out", "header_shown").join(body, "output_id", "left")
    head = header_text(F.col("line_count"), F.col("lines_out"), marker)
    z = F.lit(0).cast("long")
    return d.select(
        "output_id",
        (F.coalesce("_bl", z) + F.when(F.col("header_shown"), 1).otherwise(0)).cast("long").alias("compact_lines"),
        (F.coalesce("_bb", z) + F.when(F.col("header_shown"), F.octet_length(head)).otherwise(0))
        .cast("long").alias("compact_bytes"))


def compare_outputs(raw: DataFrame, compact: DataFrame, key: str = "case_id") -> DataFrame:
    """B1: ``raw(case_id, raw_lines, raw_bytes, raw_rc)`` joined with
    ``compact(case_id, compact_lines, compact_bytes, compact_rc)``; line and
    byte ratios (1.0 when the raw side is 0); equal exit codes."""
    d = raw.join(compact, key, "inner")
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(1.0))
    return d.withColumns({"line_ratio": ratio("compact_lines", "raw_lines"),
                          "byte_ratio": ratio("compact_bytes", "raw_bytes"),
                          "success": F.col("raw_rc") == F.col("compact_rc")})


def comparison_summary(cmp: DataFrame) -> DataFrame:
    """B2: number of cases, unweighted mean ratios, cases with equal exit codes."""
    return cmp.agg(F.count(F.lit(1)).alias("cases"), F.avg("line_ratio").alias("avg_line_ratio"),
                   F.avg("byte_ratio").alias("avg_byte_ratio"), F.count_if("success").alias("matching_exit_codes"))
