"""Usage analytics over invocation facts.

``inv`` has the invocation-log columns (§1.2 of the survey): ``ts, session_id,
command, args, stdout_bytes, stdout_lines, compressed_lines, full``.
Every report is one hash aggregate (partial aggregation before the shuffle, so
a hot command or session costs one partial row per task, not a hot task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.usage import (DEFAULT_BYTES_PER_TOKEN, day_label, effective_bytes, effective_lines,
                               savings_pct, tokens)

# Fixed values of the reference reports.
REPEAT_TOP = 20
TOP_GROUPS = 20
DEFAULT_COMMAND = "?"
DEFAULT_SESSION = "?"

SAVINGS_COLS = ["total_calls", "raw_lines", "effective_lines", "saved_lines", "line_savings_pct",
                "raw_bytes", "effective_bytes_estimate", "saved_bytes_estimate",
                "byte_savings_pct_estimate", "raw_tokens_estimate", "effective_tokens_estimate",
                "saved_tokens_estimate", "full_calls", "compressed_calls"]


def normalize(inv: DataFrame) -> DataFrame:
    """Defaults of the reference reader: command/session '?', numbers 0, args []."""
    cols = {
        "command": F.coalesce(F.col("command"), F.lit(DEFAULT_COMMAND)),
        "session_id": F.coalesce(F.col("session_id"), F.lit(DEFAULT_SESSION)),
        "stdout_bytes": F.coalesce(F.col("stdout_bytes").cast("long"), F.lit(0).cast("long")),
        "stdout_lines": F.coalesce(F.col("stdout_lines").cast("long"), F.lit(0).cast("long")),
        "full": F.coalesce(F.col("full"), F.lit(False)),
    }
    if "args" in inv.columns:
        cols["args"] = F.coalesce(F.col("args"), F.array().cast("array<string>"))
    return inv.withColumns(cols)


def with_effective(inv: DataFrame) -> DataFrame:
    """Add E4/E5 per call: ``eff_lines``, ``eff_bytes``."""
    inv = normalize(inv)
    eff = effective_lines(F.col("stdout_lines"), F.col("compressed_lines").cast("long"), F.col("full"))
    return (inv.withColumn("eff_lines", eff)
            .withColumn("eff_bytes", effective_bytes(F.col("stdout_bytes"), F.col("stdout_lines"),
                                                     F.col("eff_lines"))))


def _savings_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("stdout_lines").alias("raw_lines"),
        F.sum("eff_lines").alias("effective_lines"),
        F.sum("stdout_bytes").alias("raw_bytes"),
        F.sum("eff_bytes").alias("effective_bytes_estimate"),
        F.count_if(F.col("full")).alias("full_calls"),
        F.count_if(~F.col("full") & (F.col("eff_lines") != F.col("stdout_lines"))).alias("compressed_calls"),
    ]


def _savings_finish(bytes_per_token: float) -> dict[str, Column]:
    saved_lines = F.col("raw_lines") - F.col("effective_lines")
    saved_bytes = F.col("raw_bytes").cast("double") - F.col("effective_bytes_estimate")
    return {
        "saved_lines": saved_lines,
        "line_savings_pct": savings_pct(saved_lines, F.col("raw_lines")),
        "saved_bytes_estimate": saved_bytes,
        "byte_savings_pct_estimate": savings_pct(saved_bytes, F.col("raw_bytes")),
        "raw_tokens_estimate": tokens(F.col("raw_bytes"), bytes_per_token),
        "effective_tokens_estimate": tokens(F.col("effective_bytes_estimate"), bytes_per_token),
        "saved_tokens_estimate": tokens(saved_bytes, bytes_per_token),
    }


def _savings(grouped, keys: Sequence[str], bytes_per_token: float, extra: Sequence[Column] = ()) -> DataFrame:
    df = grouped.agg(*_savings_aggs(), *extra)
    df = df.withColumns(_savings_finish(bytes_per_token))
    extra_names = [c for c in df.columns if c not in SAVINGS_COLS and c not in keys]
    return df.select(*keys, *SAVINGS_COLS, *extra_names)


def savings(inv: DataFrame, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """One-row savings summary."""
    return _savings(with_effective(inv).groupBy(), [], bytes_per_token)


def savings_by_command(inv: DataFrame, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """Per command, ordered by saved tokens desc, command."""
    df = _savings(with_effective(inv).groupBy("command"), ["command"], bytes_per_token)
    return df.orderBy(F.desc("saved_tokens_estimate"), F.asc("command"))


def savings_with_total(inv: DataFrame, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """A6 + A7 in one pass: ``rollup('command')``; the total row has ``is_total``."""
    df = with_effective(inv).rollup("command").agg(*_savings_aggs(), F.grouping("command").alias("_g"))
    df = df.withColumns(_savings_finish(bytes_per_token)).withColumn("is_total", F.col("_g") == 1)
    return df.select("command", "is_total", *SAVINGS_COLS)


def savings_by_key(inv: DataFrame, key: Column, key_name: str = "key",
                   bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """A8/A9/A12 shape: per group, with first/last timestamp; ordered by start
    (groups without any timestamp last), then key."""
    d = with_effective(inv).withColumn(key_name, key)
    df = _savings(d.groupBy(key_name), [key_name], bytes_per_token,
                  extra=[F.min("ts").alias("start"), F.max("ts").alias("end")])
    return df.orderBy(F.asc_nulls_last("start"), F.asc(key_name))


def savings_by_session(inv: DataFrame, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """A8 (also A12: one run's log is the same plan with its session key)."""
    return savings_by_key(inv, F.coalesce(F.col("session_id"), F.lit(DEFAULT_SESSION)), "key", bytes_per_token)


def savings_by_day(inv: DataFrame, bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """Per UTC day ('unknown' without timestamp)."""
    return savings_by_key(inv, day_label(F.col("ts")), "key", bytes_per_token)


def savings_cube(inv: DataFrame, key: Column, key_name: str = "key",
                 bytes_per_token: float = DEFAULT_BYTES_PER_TOKEN) -> DataFrame:
    """A10: per group and per (group, command) in one scan, plus the grand total.

    ``grouping sets ((key, command), (key), ())``; ``level`` is 'group_command',
    'group' or 'total'.  Nesting into a per-group ``by_command`` list happens only
    at a JSON sink.
    """
    d = with_effective(inv).withColumn(key_name, key)
    df = (d.groupingSets([[key_name, "command"], [key_name], []], key_name, "command")
          .agg(*_savings_aggs(), F.min("ts").alias("start"), F.max("ts").alias("end"),
               F.grouping_id().alias("_gid")))
    df = df.withColumns(_savings_finish(bytes_per_token))
    level = (F.when(F.col("_gid") == 0, "group_command").when(F.col("_gid") == 1, "group")
             .otherwise("total"))
    return df.select(F.col(key_name), "command", level.alias("level"), *SAVINGS_COLS, "start", "end")


def top_groups(groups: DataFrame, n: int = TOP_GROUPS, key_name: str = "key") -> DataFrame:
    """The ``n`` groups with most saved tokens (then start, key).
    TakeOrderedAndProject keeps only ``n`` rows per task before the final merge."""
    return (groups.orderBy(F.desc("saved_tokens_estimate"), F.asc_nulls_first("start"), F.asc(key_name))
            .limit(n))


def groups_remaining(groups: DataFrame, n: int = TOP_GROUPS) -> DataFrame:
    """A11 footer: how many groups are not shown ("N more")."""
    return groups.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("more"))


def spend_by_command(inv: DataFrame) -> DataFrame:
    """A1: bytes, lines and calls per command; bytes desc, command."""
    inv = normalize(inv)
    return (inv.groupBy("command")
            .agg(F.sum("stdout_bytes").alias("stdout_bytes"), F.sum("stdout_lines").alias("stdout_lines"),
                 F.count(F.lit(1)).alias("calls"))
            .orderBy(F.desc("stdout_bytes"), F.asc("command")))


def invocation_count(inv: DataFrame) -> DataFrame:
    """A5: total invocations."""
    return inv.agg(F.count(F.lit(1)).alias("total_invocations"))


def repeated_invocations(inv: DataFrame, top: int = REPEAT_TOP) -> DataFrame:
    """A2: (command, args) seen more than once, top ``top`` by count."""
    inv = normalize(inv)
    return (inv.groupBy("command", "args").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .orderBy(F.desc("n"), F.asc("command"), F.asc("args"))
            .limit(top))


def bypass_by_session(inv: DataFrame) -> DataFrame:
    """A3: sessions with at least one bypassed call; bypass count desc."""
    inv = normalize(inv)
    df = (inv.groupBy("session_id")
          .agg(F.count_if(F.col("full")).alias("full_calls"), F.count(F.lit(1)).alias("total_calls"))
          .where(F.col("full_calls") > 0))
    return (df.withColumn("full_pct", F.lit(100.0) * F.col("full_calls") / F.col("total_calls"))
            .orderBy(F.desc("full_calls"), F.asc("session_id")))


def bypass_by_command(inv: DataFrame) -> DataFrame:
    """A4: bypass rate, compacted calls (``compressed_lines`` present and not
    bypassed) and their saved lines, per command with either; rate desc."""
    inv = normalize(inv)
    compacted = ~F.col("full") & F.col("compressed_lines").isNotNull()
    df = (inv.groupBy("command")
          .agg(F.count_if(F.col("full")).alias("full_calls"),
               F.count_if(compacted).alias("compacted_calls"),
               F.count(F.lit(1)).alias("total_calls"),
               F.coalesce(F.sum(F.when(compacted, F.col("stdout_lines") - F.col("compressed_lines"))),
                          F.lit(0)).cast("long").alias("lines_saved"))
          .where((F.col("full_calls") > 0) | (F.col("compacted_calls") > 0)))
    return (df.withColumn("full_rate", F.col("full_calls") / F.col("total_calls"))
            .orderBy(F.desc("full_rate"), F.asc("command")))


def filter_time(inv: DataFrame, since=None, until=None) -> DataFrame:
    """S3: inclusive bounds.  A missing/bad timestamp fails ``since`` and
    passes ``until`` (QUIRK 2, fixed as the code intends)."""
    if since is not None:
        inv = inv.where(F.col("ts").isNotNull() & (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until is not None:
        inv = inv.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(until).cast("timestamp")))
    return inv
