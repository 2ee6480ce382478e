"""Per-output compaction facts, the rows of the invocation log (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADER_MIN_LINES_SAVED, header_shown, newline_count, token_estimate
from .lines import is_binary_column, text_column

METRIC_COLS = ["output_id", "command", "line_count", "stdout_lines", "stdout_bytes", "estimated_tokens",
               "lines_out", "bytes_out", "compressed_lines", "header_shown"]


def output_facts(outputs: DataFrame, key: str = "output_id") -> DataFrame:
    """Sizes of the raw outputs; the text blob is dropped here, before any shuffle."""
    text = text_column(outputs)
    cols = [F.col(key).alias("output_id"), F.col("command"),
            F.when(F.instr(text, "\r") == 0, newline_count(text) + 1)
            .otherwise(F.size(F.split(text, "\\r\\n|\\r|\\n", -1))).alias("_pieces"),
            (F.substring(text, -1, 1).rlike("^[\\r\\n]$") | (F.length(text) == 0)).alias("_ends_eol"),
            newline_count(text).cast("long").alias("stdout_lines"),
            F.octet_length("stdout").cast("long").alias("stdout_bytes")]
    for extra in ("args", "full", "session_id", "ts"):
        if extra in outputs.columns:
            cols.append(F.col(extra))
    d = outputs.select(*cols)
    # splitlines count: pieces, minus the empty piece after a final terminator
    return d.withColumn("line_count", (F.col("_pieces") - F.col("_ends_eol").cast("int")).cast("long")) \
        .drop("_pieces", "_ends_eol")


def compaction_metrics(outputs: DataFrame, compacted: DataFrame, key: str = "output_id",
                       min_saved: int = HEADER_MIN_LINES_SAVED) -> DataFrame:
    """Lines and bytes in and out per output, the header rule (E13) and the
    token estimate (E3).  ``compressed_lines`` is NULL when the line count did
    not change, as the log writes it."""
    facts = output_facts(outputs, key)
    out = (compacted.groupBy(F.col(key).alias("output_id"))
           .agg(F.count(F.lit(1)).alias("lines_out"), F.sum(F.length("line") if is_binary_column(outputs) else F.octet_length("line"))
                .cast("long").alias("bytes_out")))
    d = facts.join(out, "output_id", "left")
    d = d.withColumns({
        "lines_out": F.coalesce(F.col("lines_out"), F.lit(0).cast("long")),
        "bytes_out": F.coalesce(F.col("bytes_out"), F.lit(0).cast("long")),
        "estimated_tokens": token_estimate(F.col("stdout_bytes")),
    })
    d = d.withColumns({
        "compressed_lines": F.when(F.col("lines_out") != F.col("line_count"), F.col("lines_out")),
        "header_shown": header_shown(F.col("line_count"), F.col("lines_out"), F.col("bytes_out"), min_saved),
    })
    rest = [c for c in d.columns if c not in METRIC_COLS]
    return d.select(*METRIC_COLS, *rest)
