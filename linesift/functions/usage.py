"""Column expressions of the usage reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BYTES_PER_TOKEN = 4.0


def effective_lines(raw_lines: Column, compressed_lines: Column, full: Column) -> Column:
    """Raw if the call bypassed compaction, else compressed lines, else raw."""
    return F.when(F.coalesce(full, F.lit(False)), raw_lines) \
        .otherwise(F.coalesce(compressed_lines, raw_lines))


def effective_bytes(raw_bytes: Column, raw_lines: Column, eff_lines: Column) -> Column:
    """E5: raw bytes scaled by the line ratio; raw bytes when raw lines <= 0."""
    return F.when(raw_lines > 0, raw_bytes.cast("double") * (eff_lines.cast("double") / raw_lines)) \
        .otherwise(raw_bytes.cast("double"))


def tokens(n_bytes: Column, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> Column:
    """Plain division, no ceil (unlike the per-call estimate E3)."""
    return n_bytes.cast("double") / F.lit(float(bytes_per_token))


def delta_pct(baseline: Column, treatment: Column) -> Column:
    """100 * (t - b) / b; NULL when b is NULL or 0, or t is NULL."""
    return F.when((baseline.isNull()) | (baseline == 0) | treatment.isNull(), F.lit(None).cast("double")) \
        .otherwise(F.lit(100.0) * (treatment - baseline).cast("double") / baseline.cast("double"))


def savings_pct(saved: Column, raw: Column) -> Column:
    """100 * saved / raw, 0.0 when raw <= 0."""
    return F.when(raw > 0, F.lit(100.0) * saved.cast("double") / raw.cast("double")).otherwise(F.lit(0.0))


def day_label(ts: Column) -> Column:
    """UTC day, 'unknown' without a timestamp (session time zone is UTC)."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))
