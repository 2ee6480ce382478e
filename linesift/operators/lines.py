"""Captured outputs -> line table.

``outputs``: ``output_id, command, args ARRAY<STRING>, stdout STRING|BINARY``
(optionally ``full BOOLEAN``).  BINARY stdout is read one char per byte
(ISO-8859-1) so that byte regexes and byte counts stay exact.

``lines``: ``output_id, line_no INT (0-based), line STRING`` with the line
terminator kept, as D2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import _SPLIT_BYTES_LINES, _SPLIT_STR_LINES, other_terminators, probably_binary


def is_binary_column(outputs: DataFrame, col: str = "stdout") -> bool:
    return isinstance(outputs.schema[col].dataType, BinaryType)


def line_bytes(line: Column, binary_source: bool) -> Column:
    """A compacted line as the bytes to write: one byte per character where the
    output came as bytes, UTF-8 otherwise."""
    return F.encode(line, "ISO-8859-1" if binary_source else "UTF-8")


def text_column(outputs: DataFrame, col: str = "stdout"):
    """stdout as a STRING column (byte-per-char for BINARY input)."""
    if is_binary_column(outputs, col):
        return F.decode(F.col(col), "ISO-8859-1")
    return F.col(col)


def binary_flag(outputs: DataFrame, col: str = "stdout"):
    """E2 on either STRING (UTF-8 bytes) or BINARY stdout."""
    c = F.col(col)
    if not is_binary_column(outputs, col):
        c = F.encode(c, "UTF-8")
    return probably_binary(c)


def to_lines(outputs: DataFrame, key: str = "output_id", col: str = "stdout",
             universal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode each output into ordered lines; other columns are dropped first
    (only ``key``, ``keep`` and the line go into the shuffle).

    Text whose only terminator is '\\n' is split on '\\n' (no regex engine) and
    the terminator is put back on every piece but the last; other text takes
    the lookbehind split of E1, which keeps terminators itself.
    """
    text = text_column(outputs, col)
    fast = ~other_terminators(text, universal)
    parts = F.when(fast, F.split(text, "\n", -1)).otherwise(
        F.split(text, _SPLIT_STR_LINES if universal else _SPLIT_BYTES_LINES, -1))
    d = outputs.select(F.col(key), *[F.col(k) for k in keep], fast.alias("_fast"), parts.alias("_parts"))
    d = d.select(F.col(key), *[F.col(k) for k in keep], "_fast", F.size("_parts").alias("_n"),
                 F.posexplode("_parts").alias("line_no", "_piece"))
    last = F.col("line_no") == F.col("_n") - 1
    line = F.when(F.col("_fast") & ~last, F.concat(F.col("_piece"), F.lit("\n"))).otherwise(F.col("_piece"))
    return (d.where(~(last & (F.col("_piece") == F.lit(""))))
            .select(F.col(key), *[F.col(k) for k in keep], F.col("line_no").cast("int").alias("line_no"),
                    line.alias("line")))
