"""Experiment analytics over agent event logs of paired trials.

Events of many runs are one DataFrame keyed by ``run_id``; ``line_no`` is the
event's position in its log (the reference keeps the *last* value of each
field).  Every operator is a hash aggregate keyed by run or trial: partial
aggregation combines a hot run map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agents import DEFAULT_WRAPPER, program_name, wrapper_used_message, wrapper_used_thread
from ..functions.usage import delta_pct
from .scan import materialize, null_safe_keys

# Fixed values of the reference: the compared metrics, their labels, variant names.
METRICS = [("input_tokens", "Input Tokens"), ("output_tokens", "Output Tokens"),
           ("command_count", "Shell Commands")]
BASELINE = "baseline"
TREATMENT = "treatment"
MEDIAN_PARTS = 256          # parts into which a group's values are cut to find its median


def _last(value: Column, cond: Column, order: str = "line_no") -> Column:
    """Value on the last row (by ``order``) where ``cond`` holds."""
    return F.max_by(F.when(cond, value), F.when(cond, F.col(order)))


def commands_by_program(calls: DataFrame, run: str = "run_id", wrapper: str = DEFAULT_WRAPPER) -> DataFrame:
    """X3 (long form): calls per (run, program E7).  ``calls`` has ``command``."""
    return (calls.groupBy(run, program_name(F.col("command"), wrapper).alias("program"))
            .agg(F.count(F.lit(1)).alias("n")))


def program_map(counts: DataFrame, run: str = "run_id") -> DataFrame:
    """X3 as a map per run (bounded by the number of distinct programs)."""
    return counts.groupBy(run).agg(
        F.map_from_entries(F.collect_list(F.struct("program", "n"))).alias("command_counts_by_prog"))


def thread_calls(events: DataFrame) -> DataFrame:
    """Flavour A command executions: ``item.completed`` with ``item.type = command_execution``."""
    cond = (F.col("type") == "item.completed") & (F.col("item.type") == "command_execution")
    return events.where(cond).select("run_id", "line_no", F.coalesce(F.col("item.command"), F.lit("")).alias("command"))


def thread_run_facts(events: DataFrame, wrapper: str = DEFAULT_WRAPPER) -> DataFrame:
    """Last thread id, last usage, command count, wrapper count, counts by program."""
    is_cmd = (F.col("type") == "item.completed") & (F.col("item.type") == "command_execution")
    cmd = F.coalesce(F.col("item.command"), F.lit(""))
    usage = _last(F.col("usage"), F.col("type") == "turn.completed")
    facts = events.groupBy("run_id").agg(
        _last(F.col("thread_id"), F.col("type") == "thread.started").alias("thread_id"),
        usage.alias("_usage"),
        F.count_if(is_cmd).alias("command_count"),
        F.count_if(is_cmd & wrapper_used_thread(cmd, wrapper)).alias("wrapper_command_count"))
    facts = facts.select("run_id", "thread_id", F.col("_usage.input_tokens").alias("input_tokens"),
                         F.col("_usage.cached_input_tokens").alias("cached_input_tokens"),
                         F.col("_usage.output_tokens").alias("output_tokens"), "command_count",
                         "wrapper_command_count")
    progs = program_map(commands_by_program(thread_calls(events), wrapper=wrapper))
    return facts.join(progs, "run_id", "left")


def message_calls(events: DataFrame) -> DataFrame:
    """Flavour B shell calls: ``tool_use`` blocks named ``Bash`` in assistant messages."""
    blocks = (events.where(F.col("type") == "assistant")
              .select("run_id", "line_no", F.posexplode("message.content").alias("block_no", "b")))
    return (blocks.where((F.col("b.type") == "tool_use") & (F.col("b.name") == "Bash"))
            .select("run_id", "line_no", "block_no",
                    F.coalesce(F.col("b.input.command"), F.lit("")).alias("command")))


def message_run_facts(events: DataFrame, wrapper: str = DEFAULT_WRAPPER) -> DataFrame:
    """Last session id, usage of the last ``result`` (input = input + cache read
    + cache creation; 0 where the result has no usage, NULL without a result),
    count of Bash calls, wrapper calls, counts by program."""
    is_result = F.col("type") == "result"
    base = events.groupBy("run_id").agg(
        _last(F.col("session_id"), F.col("type") == "system").alias("session_id"),
        _last(F.col("usage"), is_result).alias("_u"), F.max(is_result).alias("_ended"))
    z = F.lit(0).cast("long")

    def used(name: str) -> Column:
        return F.when(F.col("_ended"), F.coalesce(F.col(f"_u.{name}"), z))

    parts = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    base = base.select(
        "run_id", "session_id", (used(parts[0]) + used(parts[1]) + used(parts[2])).alias("input_tokens"),
        used(parts[1]).alias(parts[1]), used(parts[2]).alias(parts[2]), used("output_tokens").alias("output_tokens"))
    calls = message_calls(events)
    counts = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("command_count"),
        F.count_if(wrapper_used_message(F.col("command"), wrapper)).alias("wrapper_command_count"))
    progs = program_map(commands_by_program(calls, wrapper=wrapper))
    out = base.join(counts, "run_id", "left").join(progs, "run_id", "left")
    return out.withColumns({"command_count": F.coalesce("command_count", z),
                            "wrapper_command_count": F.coalesce("wrapper_command_count", z)})


def attach_savings(runs: DataFrame, session_savings: DataFrame, run_key: str = "thread_id",
                   savings_key: str = "key") -> DataFrame:
    """Each run's savings by its thread/session id (absent log -> NULLs)."""
    s = session_savings.select(F.col(savings_key).alias("_k"),
                               F.struct(*[c for c in session_savings.columns if c != savings_key]).alias("savings"))
    return runs.join(s, runs[run_key] == s["_k"], "left").drop("_k")


def with_order(trials: DataFrame, interleave: bool = True, trial: str = "trial") -> DataFrame:
    """With interleaving, even trials ran treatment first."""
    first = F.when(F.lit(interleave) & (F.col(trial) % 2 == 0), "treatment-first").otherwise("baseline-first")
    return trials.withColumn("order", first)


def trial_deltas(runs: DataFrame, trial: str = "trial", variant: str = "variant",
                 baseline: str = BASELINE, treatment: str = TREATMENT) -> DataFrame:
    """Pair the two variants of every trial; one row per (trial, metric) with
    baseline, treatment and delta % (E10).  A missing variant gives NULLs."""
    aggs = []
    for m, _ in METRICS:
        aggs.append(F.max_by(F.when(F.col(variant) == baseline, F.col(m)),
                             F.when(F.col(variant) == baseline, F.lit(1))).alias(f"b_{m}"))
        aggs.append(F.max_by(F.when(F.col(variant) == treatment, F.col(m)),
                             F.when(F.col(variant) == treatment, F.lit(1))).alias(f"t_{m}"))
    paired = runs.groupBy(trial).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"),
                              F.col(f"b_{m}").cast("long").alias("baseline"),
                              F.col(f"t_{m}").cast("long").alias("treatment")) for m, label in METRICS])
    d = paired.select(trial, F.explode(rows).alias("r")).select(trial, "r.*")
    return d.withColumn("delta_pct", delta_pct(F.col("baseline"), F.col("treatment")))


def group_medians(values: DataFrame, keys: list[str], value: str, parts: int = MEDIAN_PARTS) -> DataFrame:
    """``keys`` and the exact ``median`` (of an even count the mean of the two middle
    values) of the non-NULL ``value``s, without gathering a group's values.

    Approximate quantiles, a sketch of bounded size per group, only cut the group's
    range into ``parts`` (2 or more); the rows of every part are counted exactly, so it is known
    which one or two parts hold the middle ranks.  Only those parts' distinct values,
    with their counts, are ordered: about 1/parts of a group however its values lie,
    or a single value where one fills a part.
    """
    v, names = null_safe_keys(values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")), keys)
    v = materialize(v.groupBy(*keys, *names, "_x").agg(F.count(F.lit(1)).alias("_c")))
    at = [k / parts for k in range(1, parts)]
    edges = v.groupBy(*names).agg(F.percentile_approx("_x", at, 20 * parts).alias("_edges"))
    # the part of a value: how many edges lie below it
    v = v.join(edges, names).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_x")))).drop("_edges")
    sizes = v.groupBy(*names, "_part").agg(F.sum("_c").alias("_n"))
    group = Window.partitionBy(*names)
    sizes = sizes.withColumns({"_before": F.sum("_n").over(group.orderBy("_part")) - F.col("_n"), "_all": F.sum("_n").over(group)})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1         # ranks from 1
    hold = sizes.where(((F.col("_before") < low) & (low <= F.col("_before") + F.col("_n")))
                       | ((F.col("_before") < high) & (high <= F.col("_before") + F.col("_n"))))
    near = v.join(hold.drop("_n"), [*names, "_part"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*names, "_part").orderBy("_x"))
    near = near.withColumn("_upto", upto)
    middle = [F.min(F.when(F.col("_upto") >= rank, F.col("_x"))) for rank in (low, high)]
    return near.groupBy(*keys, *(k for k in names if k not in keys)).agg(((middle[0] + middle[1]) / 2).alias("median")).select(*keys, "median")


def aggregate_deltas(deltas: DataFrame) -> DataFrame:
    """Per metric: non-null count, mean, median, sample stdev (0.0 for one
    value, NULL for none).  The median is exact (``group_medians``)."""
    d = deltas.groupBy("metric", "label").agg(
        F.count("delta_pct").alias("count"), F.avg("delta_pct").alias("mean_pct"), F.stddev_samp("delta_pct").alias("_sd"))
    mid = group_medians(deltas, ["metric", "label"], "delta_pct").withColumnsRenamed({"metric": "_metric", "label": "_label"})
    d = d.join(mid, F.col("metric").eqNullSafe(F.col("_metric")) & F.col("label").eqNullSafe(F.col("_label")), "left")
    sd = F.when(F.col("count") == 1, F.lit(0.0)).when(F.col("count") == 0, F.lit(None)).otherwise(F.col("_sd"))
    return d.select("metric", "label", "count", "mean_pct", F.col("median").alias("median_pct"), sd.cast("double").alias("stdev_pct_points"))


def trial_outcomes(runs: DataFrame, trial: str = "trial", interleave: bool = True) -> DataFrame:
    """X8 + X7: a trial succeeded when every run's return code is 0; the
    hidden-test result, when present, is carried as a nullable flag."""
    aggs = [F.bool_and(F.col("returncode") == 0).alias("all_succeeded"), F.count(F.lit(1)).alias("runs")]
    if "hidden_test_passed" in runs.columns:
        aggs.append(F.bool_and("hidden_test_passed").alias("hidden_tests_passed"))
    return with_order(runs.groupBy(trial).agg(*aggs), interleave, trial)
