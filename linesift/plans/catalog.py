"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library operators on a
derivation of the given tables (``inputs.py``).  ``ORACLE[name]`` is the same
result written as plain SQL for DuckDB (tables registered as views), used by
the driver's side-by-side check.  Doubles are rounded to 4 digits on both
sides; every computed column carries the same alias on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings the registered queries assume: UTC session time (day
    labels, timestamp casts) and a checkpoint folder (the cluster's when set)."""
    from ..session import ensure_checkpoint_dir
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (hash comparison across engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- SQL pieces

NL = "chr(10)"


def sql_lines(source: str, key: str, text: str, extra: dict[str, str] | None = None,
              name: str = "lines") -> str:
    """bytes.splitlines(keepends=True) for text without '\\r' (the driver tables have
    none) -> CTE ``name(output_id, <extra>, line_no, line)``."""
    extra = extra or {}
    sel = "".join(f", {expr} AS {alias}" for alias, expr in extra.items())
    keep = "".join(f", {alias}" for alias in extra)
    return f"""
_parts_{name} AS (
  SELECT {key} AS output_id{sel}, string_split({text}, {NL}) AS p FROM {source}
),
_idx_{name} AS (
  SELECT *, unnest(generate_series(1, len(p))) AS i FROM _parts_{name}
),
{name} AS (
  SELECT output_id{keep}, CAST(i - 1 AS INTEGER) AS line_no,
         CASE WHEN i < len(p) THEN p[i] || {NL} ELSE p[i] END AS line
  FROM _idx_{name} WHERE NOT (i = len(p) AND p[i] = '')
)"""


def sql_collapse(limit: int | None) -> str:
    """T1 (+T2) over the ``lines`` CTE -> ``compacted`` CTE."""
    lim_line = f"AND first_seq < {limit}" if limit is not None else ""
    lim_note = f"AND first_seq + 1 < {limit}" if limit is not None else ""
    trunc = "" if limit is None else f"""
  UNION ALL
  SELECT output_id, CAST({limit} AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# ... ' || CAST(total_e - {limit} AS VARCHAR) || ' more lines truncated' || {NL},
         CAST(total_e - {limit} AS BIGINT)
  FROM _seqd WHERE line_no = 0 AND total_e > {limit}"""
    return f"""
_flag AS (
  SELECT *, CASE WHEN lag(line) OVER w IS NULL OR lag(line) OVER w <> line THEN 1 ELSE 0 END AS new_run
  FROM lines WINDOW w AS (PARTITION BY output_id ORDER BY line_no)
),
_runs AS (
  SELECT *, sum(new_run) OVER (PARTITION BY output_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run_id
  FROM _flag
),
_sized AS (
  SELECT *, count(*) OVER (PARTITION BY output_id, run_id) AS run_len,
         line_no - min(line_no) OVER (PARTITION BY output_id, run_id) AS k
  FROM _runs
),
_emit AS (
  SELECT *, CASE WHEN run_len <= 3 THEN 1 WHEN k = 0 THEN 2 ELSE 0 END AS e FROM _sized
),
_seqd AS (
  SELECT *, sum(e) OVER (PARTITION BY output_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - e AS first_seq,
         sum(e) OVER (PARTITION BY output_id) AS total_e
  FROM _emit
),
compacted AS (
  SELECT output_id, CAST(first_seq AS BIGINT) AS seq, 'line' AS kind, CAST(line_no AS INTEGER) AS src_line_no,
         line, CAST(0 AS BIGINT) AS n_omitted
  FROM _seqd WHERE e > 0 {lim_line}
  UNION ALL
  SELECT output_id, CAST(first_seq + 1 AS BIGINT), 'note', CAST(line_no AS INTEGER),
         '# ... repeated ' || CAST(run_len AS VARCHAR) || ' times' || {NL}, CAST(run_len - 1 AS BIGINT)
  FROM _seqd WHERE run_len > 3 AND k = 0 {lim_note}{trunc}
)"""


def sql_invocations() -> str:
    """``events`` as an invocation log (same derivation as inputs.event_invocations)."""
    return """
_ev AS (
  SELECT *, TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events
),
inv AS (
  SELECT event_id, ts, 's' || CAST(user_id AS VARCHAR) AS session_id, event_type AS command, [props] AS args,
         CAST(floor(value * 100) AS BIGINT) AS stdout_bytes, k AS stdout_lines,
         CASE WHEN event_type = 'view' THEN CAST(NULL AS BIGINT) WHEN event_type = 'click' THEN k
              ELSE CAST(floor(k / 2) AS BIGINT) END AS compressed_lines,
         (event_type = 'error' AND k < 10) AS "full"
  FROM _ev
)"""


def sql_effective(src: str = "inv") -> str:
    return f"""
eff AS (
  SELECT *, CASE WHEN coalesce("full", false) THEN stdout_lines ELSE coalesce(compressed_lines, stdout_lines) END
         AS eff_lines
  FROM {src}
),
eff2 AS (
  SELECT *, CASE WHEN stdout_lines > 0
                 THEN CAST(stdout_bytes AS DOUBLE) * (CAST(eff_lines AS DOUBLE) / CAST(stdout_lines AS DOUBLE))
                 ELSE CAST(stdout_bytes AS DOUBLE) END AS eff_bytes
  FROM eff
)"""


def sql_savings_cols() -> str:
    raw_l, eff_l = "sum(stdout_lines)", "sum(eff_lines)"
    raw_b, eff_b = "CAST(sum(stdout_bytes) AS DOUBLE)", "sum(eff_bytes)"
    return f"""
  CAST(count(*) AS BIGINT) AS total_calls,
  CAST({raw_l} AS BIGINT) AS raw_lines,
  CAST({eff_l} AS BIGINT) AS effective_lines,
  CAST({raw_l} - {eff_l} AS BIGINT) AS saved_lines,
  round(CASE WHEN {raw_l} > 0 THEN 100.0::DOUBLE * CAST({raw_l} - {eff_l} AS DOUBLE) / CAST({raw_l} AS DOUBLE)
        ELSE 0.0::DOUBLE END, 4) AS line_savings_pct,
  CAST(sum(stdout_bytes) AS BIGINT) AS raw_bytes,
  round({eff_b}, 4) AS effective_bytes_estimate,
  round({raw_b} - {eff_b}, 4) AS saved_bytes_estimate,
  round(CASE WHEN sum(stdout_bytes) > 0 THEN 100.0::DOUBLE * ({raw_b} - {eff_b}) / {raw_b} ELSE 0.0::DOUBLE END, 4)
    AS byte_savings_pct_estimate,
  round({raw_b} / 4.0::DOUBLE, 4) AS raw_tokens_estimate,
  round({eff_b} / 4.0::DOUBLE, 4) AS effective_tokens_estimate,
  round(({raw_b} - {eff_b}) / 4.0::DOUBLE, 4) AS saved_tokens_estimate,
  CAST(count(*) FILTER (WHERE coalesce("full", false)) AS BIGINT) AS full_calls,
  CAST(count(*) FILTER (WHERE NOT coalesce("full", false) AND eff_lines <> stdout_lines) AS BIGINT) AS compressed_calls"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)
