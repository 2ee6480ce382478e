"""Registered experiment queries.

* Trials: ``orders`` grouped by month = trial; even order keys = baseline, odd =
  treatment; per run: input tokens = sum of floor(total
  price), output tokens = orders, commands = distinct customers, return code 1
  when more than a quarter of the orders are urgent.
* Agent events: ``conversations`` as event logs, one run per conversation;
  system turns start a thread/session, assistant turns are shell calls whose
  command is the turn text, user turns carry the usage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.agents import DEFAULT_WRAPPER
from ..operators import trials as X
from ..operators.usage import savings_by_session
from .catalog import register, rounded, sql_effective, sql_invocations, sql_savings_cols, with_ctes
from .inputs import event_invocations, table

W = DEFAULT_WRAPPER


def trial_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    trial = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    return (o.groupBy(trial.alias("trial"),
                      F.when(F.col("o_orderkey") % 2 == 0, X.BASELINE).otherwise(X.TREATMENT).alias("variant"))
            .agg(F.sum(F.floor("o_totalprice")).cast("long").alias("input_tokens"),
                 F.count(F.lit(1)).alias("output_tokens"),
                 F.countDistinct("o_custkey").alias("command_count"),
                 F.when(F.count_if(F.col("o_orderpriority") == "1-URGENT") * 4 > F.count(F.lit(1)), 1)
                 .otherwise(0).alias("returncode")))


_SQL_RUNS = """
runs AS (
  SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS trial,
         CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS variant,
         CAST(sum(floor(o_totalprice)) AS BIGINT) AS input_tokens,
         CAST(count(*) AS BIGINT) AS output_tokens,
         CAST(count(DISTINCT o_custkey) AS BIGINT) AS command_count,
         CASE WHEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 4 > count(*) THEN 1 ELSE 0 END AS returncode
  FROM orders GROUP BY 1, 2
),
paired AS (
  SELECT trial,
         max(input_tokens) FILTER (WHERE variant = 'baseline') AS b_input_tokens,
         max(input_tokens) FILTER (WHERE variant = 'treatment') AS t_input_tokens,
         max(output_tokens) FILTER (WHERE variant = 'baseline') AS b_output_tokens,
         max(output_tokens) FILTER (WHERE variant = 'treatment') AS t_output_tokens,
         max(command_count) FILTER (WHERE variant = 'baseline') AS b_command_count,
         max(command_count) FILTER (WHERE variant = 'treatment') AS t_command_count
  FROM runs GROUP BY trial
),
deltas AS (""" + "\n  UNION ALL\n".join(
    f"""  SELECT trial, '{m}' AS metric, '{label}' AS label, b_{m} AS baseline, t_{m} AS treatment,
         CASE WHEN b_{m} IS NULL OR b_{m} = 0 OR t_{m} IS NULL THEN NULL
              ELSE 100.0::DOUBLE * CAST(t_{m} - b_{m} AS DOUBLE) / CAST(b_{m} AS DOUBLE) END AS delta_pct
  FROM paired""" for m, label in X.METRICS) + "\n)"


_SQL_STATS = """
stats AS (
  SELECT metric, label, count(delta_pct) AS n, avg(delta_pct) AS mean_pct, median(delta_pct) AS median_pct,
         CASE WHEN count(delta_pct) = 1 THEN 0.0::DOUBLE WHEN count(delta_pct) = 0 THEN NULL ELSE stddev_samp(delta_pct) END AS stdev
  FROM deltas GROUP BY metric, label
)"""


@register("trial_deltas", with_ctes(_SQL_RUNS) + """
SELECT trial, metric, label, baseline, treatment, round(delta_pct, 4) AS delta_pct,
       CASE WHEN trial % 2 = 0 THEN 'treatment-first' ELSE 'baseline-first' END AS "order"
FROM deltas""")
def trial_deltas(spark, sf_dir):
    """X5 + X7: per trial and metric, baseline vs treatment and delta %."""
    return rounded(X.with_order(X.trial_deltas(trial_runs(spark, sf_dir))))


@register("trial_aggregate", with_ctes(_SQL_RUNS) + """
SELECT metric, label, CAST(count(delta_pct) AS BIGINT) AS count, round(avg(delta_pct), 4) AS mean_pct,
       round(median(delta_pct), 4) AS median_pct,
       round(CASE WHEN count(delta_pct) = 1 THEN 0.0::DOUBLE WHEN count(delta_pct) = 0 THEN NULL
                  ELSE stddev_samp(delta_pct) END, 4) AS stdev_pct_points
FROM deltas GROUP BY metric, label""")
def trial_aggregate(spark, sf_dir):
    """Mean, median and sample stdev of the deltas per metric."""
    return rounded(X.aggregate_deltas(X.trial_deltas(trial_runs(spark, sf_dir))))


@register("trial_outcomes", with_ctes(_SQL_RUNS) + """
SELECT trial, bool_and(returncode = 0) AS all_succeeded, CAST(count(*) AS BIGINT) AS runs,
       CASE WHEN trial % 2 = 0 THEN 'treatment-first' ELSE 'baseline-first' END AS "order"
FROM runs GROUP BY trial""")
def trial_outcomes(spark, sf_dir):
    """X8 + X7: did every run of the trial exit 0; which variant ran first."""
    return X.trial_outcomes(trial_runs(spark, sf_dir))


# ------------------------------------------------------------- agent events

def _commands(c):
    """Assistant turns as commands: plain, through the wrapper, or in a login shell."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    cmd = F.when(kind == 1, F.concat(F.lit(f"{W} cat "), "text")) \
        .when(kind == 2, F.concat(F.lit("/bin/zsh -lc '"), "text", F.lit("'"))).otherwise(F.col("text"))
    return c.withColumn("text", F.when(F.col("role") == "assistant", cmd).otherwise(F.col("text")))


def message_events(spark, sf_dir):
    """Flavour B events (S5 shape) derived from conversations; every fifth result has no usage."""
    c = _commands(table(spark, sf_dir, "conversations"))
    typ = F.when(F.col("role") == "system", "system").when(F.col("role") == "assistant", "assistant") \
        .otherwise("result")
    block = "struct<type:string,name:string,input:struct<command:string>>"
    content = F.array(
        F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("struct<command:string>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"),
                 F.struct(F.col("text").alias("command")).alias("input"))).cast(f"array<{block}>")
    usage = F.struct(F.length("text").cast("long").alias("input_tokens"),
                     (F.col("turn") * 100).cast("long").alias("cache_read_input_tokens"),
                     F.lit(7).cast("long").alias("cache_creation_input_tokens"),
                     F.size(F.split("text", " ")).cast("long").alias("output_tokens"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), typ.alias("type"),
                    F.when(F.col("role") == "system",
                           F.concat_ws("-", F.lit("sess"), F.col("conv_id").cast("string"),
                                       F.col("turn").cast("string"))).alias("session_id"),
                    F.when(F.col("role") == "assistant", F.struct(content.alias("content"))).alias("message"),
                    F.when((typ == "result") & (F.col("turn") % 5 != 0), usage).alias("usage"))


def thread_events(spark, sf_dir):
    """Flavour A events (S4 shape) derived from conversations."""
    c = _commands(table(spark, sf_dir, "conversations"))
    typ = F.when(F.col("role") == "system", "thread.started").when(F.col("role") == "assistant", "item.completed") \
        .otherwise("turn.completed")
    return c.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), typ.alias("type"),
        F.when(F.col("role") == "system", F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("thread_id"),
        F.when(F.col("role") == "assistant",
               F.struct(F.lit("command_execution").alias("type"), F.col("text").alias("command"))).alias("item"),
        F.when(F.col("role") == "user",
               F.struct(F.length("text").cast("long").alias("input_tokens"),
                        (F.col("turn") * 10).cast("long").alias("cached_input_tokens"),
                        F.size(F.split("text", " ")).cast("long").alias("output_tokens"))).alias("usage"))


def _sql_program(c: str) -> str:
    payload = f"trim(substr({c}, strpos({c}, '/bin/zsh -lc ') + 13), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
    unq1 = f"(CASE WHEN starts_with({payload}, '''') AND ends_with({payload}, '''') THEN substr({payload}, 2, greatest(length({payload}) - 2, 0)) ELSE {payload} END)"
    unq2 = f"(CASE WHEN starts_with({unq1}, '\"') AND ends_with({unq1}, '\"') THEN substr({unq1}, 2, greatest(length({unq1}) - 2, 0)) ELSE {unq1} END)"
    shell = f"(CASE WHEN regexp_extract({unq2}, '^\\s*(\\S+)', 1) = '' THEN 'zsh' ELSE regexp_extract({unq2}, '^\\s*(\\S+)', 1) END)"
    return f"""(CASE WHEN coalesce({c}, '') = '' THEN '?'
      WHEN contains({c}, '{W} ') THEN '{W}'
      WHEN contains({c}, '/bin/zsh -lc ') THEN {shell}
      ELSE regexp_extract({c}, '^\\s*(\\S+)', 1) END)"""


_SQL_CONV = f"""
ev AS (SELECT conv_id AS run_id, turn AS line_no, role,
              CASE WHEN role <> 'assistant' THEN text WHEN (conv_id + turn) % 4 = 1 THEN '{W} cat ' || text
                   WHEN (conv_id + turn) % 4 = 2 THEN '/bin/zsh -lc ' || chr(39) || text || chr(39) ELSE text END AS text
       FROM conversations)"""


@register("message_run_facts", with_ctes(_SQL_CONV) + f"""
SELECT run_id,
  arg_max('sess-' || CAST(run_id AS VARCHAR) || '-' || CAST(line_no AS VARCHAR), line_no)
    FILTER (WHERE role = 'system') AS session_id,
  arg_max(CASE WHEN line_no % 5 <> 0 THEN CAST(length(text) AS BIGINT) + line_no * 100 + 7 ELSE 0 END, line_no)
    FILTER (WHERE role NOT IN ('system', 'assistant')) AS input_tokens,
  arg_max(CASE WHEN line_no % 5 <> 0 THEN CAST(line_no * 100 AS BIGINT) ELSE 0 END, line_no)
    FILTER (WHERE role NOT IN ('system', 'assistant')) AS cache_read_input_tokens,
  arg_max(CAST(CASE WHEN line_no % 5 <> 0 THEN 7 ELSE 0 END AS BIGINT), line_no)
    FILTER (WHERE role NOT IN ('system', 'assistant')) AS cache_creation_input_tokens,
  arg_max(CASE WHEN line_no % 5 <> 0 THEN CAST(len(string_split(text, ' ')) AS BIGINT) ELSE 0 END, line_no)
    FILTER (WHERE role NOT IN ('system', 'assistant')) AS output_tokens,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS command_count,
  CAST(count(*) FILTER (WHERE role = 'assistant' AND (
      list_contains(regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r\\x0b\\f]+|[ \\t\\n\\r\\x0b\\f]+$', '', 'g'), '\\s+'), '{W}')
      OR starts_with(text, '{W} ') OR contains(' ' || text || ' ', ' {W} '))) AS BIGINT) AS wrapper_command_count
FROM ev GROUP BY run_id""")
def message_run_facts(spark, sf_dir):
    """S5 + X2 (+X3 map, dropped here; see ``commands_by_program``)."""
    return X.message_run_facts(message_events(spark, sf_dir)).drop("command_counts_by_prog")


@register("commands_by_program", with_ctes(_SQL_CONV) + f"""
SELECT run_id, {_sql_program('text')} AS program, CAST(count(*) AS BIGINT) AS n
FROM ev WHERE role = 'assistant' GROUP BY 1, 2""")
def commands_by_program(spark, sf_dir):
    """X3 + E7: shell calls per run and program."""
    return X.commands_by_program(X.message_calls(message_events(spark, sf_dir)))


@register("thread_run_facts", with_ctes(_SQL_CONV) + f"""
SELECT run_id,
  arg_max('s' || CAST(run_id AS VARCHAR), line_no) FILTER (WHERE role = 'system') AS thread_id,
  arg_max(CAST(length(text) AS BIGINT), line_no) FILTER (WHERE role = 'user') AS input_tokens,
  arg_max(CAST(line_no * 10 AS BIGINT), line_no) FILTER (WHERE role = 'user') AS cached_input_tokens,
  arg_max(CAST(len(string_split(text, ' ')) AS BIGINT), line_no) FILTER (WHERE role = 'user') AS output_tokens,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS command_count,
  CAST(count(*) FILTER (WHERE role = 'assistant' AND (contains(' ' || text || ' ', ' {W} ')
      OR ends_with(text, '/{W}') OR contains(text, '`{W}`') OR contains(text, '{W} '))) AS BIGINT)
    AS wrapper_command_count
FROM ev GROUP BY run_id""")
def thread_run_facts(spark, sf_dir):
    """S4 + X1 (map column dropped for the oracle; see ``commands_by_program``)."""
    return X.thread_run_facts(thread_events(spark, sf_dir)).drop("command_counts_by_prog")


@register("runs_with_savings", with_ctes(_SQL_CONV, sql_invocations(), sql_effective("inv"), f"""
ss AS (SELECT session_id AS key, {sql_savings_cols()} FROM eff2 GROUP BY session_id),
runs AS (SELECT run_id, arg_max('s' || CAST(run_id AS VARCHAR), line_no) FILTER (WHERE role = 'system') AS thread_id,
                CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS command_count
         FROM ev GROUP BY run_id)""") + """
SELECT r.run_id, r.thread_id, r.command_count, ss.total_calls AS saved_calls, ss.saved_lines,
       ss.saved_tokens_estimate
FROM runs r LEFT JOIN ss ON r.thread_id = ss.key""")
def runs_with_savings(spark, sf_dir):
    """Each run's session savings (A12 / A8 per session) by thread id."""
    runs = X.thread_run_facts(thread_events(spark, sf_dir)).select("run_id", "thread_id", "command_count")
    ss = savings_by_session(event_invocations(spark, sf_dir))
    j = X.attach_savings(runs, ss)
    return rounded(j.select("run_id", "thread_id", "command_count", F.col("savings.total_calls").alias("saved_calls"),
                            F.col("savings.saved_lines").alias("saved_lines"),
                            F.col("savings.saved_tokens_estimate").alias("saved_tokens_estimate")))
