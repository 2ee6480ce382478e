"""Report sinks: trial report as JSON (K2) and markdown table rows (K3).

Both work on the small per-trial tables (one row per trial and metric); the
per-trial nesting is a ``collect_list`` bounded by the number of metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.trials import METRICS


def format_pct(c: Column) -> Column:
    """'+12.3%' or 'n/a'."""
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string("%+.1f%%", c))


def _trials(deltas: DataFrame, runs: DataFrame | None) -> DataFrame:
    """(trial, doc): a trial's index, order, summary and, with ``runs``, its results."""
    metric = F.struct("label", "baseline", "treatment", "delta_pct")
    per_trial = deltas.groupBy("trial", "order").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", metric))).alias("metrics"))
    fields = [F.col("trial").alias("index"), F.col("order"), F.struct("metrics").alias("summary")]
    if runs is not None:
        facts = F.struct(F.col("variant").alias("name"), *[c for c in runs.columns if c not in ("trial", "variant")])
        per_trial = per_trial.join(runs.groupBy("trial").agg(F.array_sort(F.collect_list(facts)).alias("results")), "trial", "left")
        fields.append(F.col("results"))
    return per_trial.select("trial", F.struct(*fields).alias("doc"))


def _aggregate(deltas: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One row: trial_count, aggregate."""
    agg = aggregate.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(
        "label", "count", "mean_pct", "median_pct", "stdev_pct_points")))).alias("aggregate"))
    return agg.join(deltas.agg(F.countDistinct("trial").alias("trial_count")), F.lit(True))              # one row each


_AS_JSON = {"ignoreNullFields": "false"}


def trial_report_json(deltas: DataFrame, aggregate: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """K2 as JSON lines: one document per trial (``kind='trial'``: index, order,
    summary and, with ``runs``, the facts of its runs) and one for the whole report
    (``kind='report'``: trial count and aggregate).  A trial has as many metrics
    and runs as there are metrics and variants."""
    per_trial = _trials(deltas, runs).select(F.lit("trial").alias("kind"), F.col("trial").alias("index"), F.to_json("doc", _AS_JSON).alias("json"))
    return per_trial.unionByName(_aggregate(deltas, aggregate).select(
        F.lit("report").alias("kind"), F.lit(None).cast("int").alias("index"), F.to_json(F.struct("trial_count", "aggregate"), _AS_JSON).alias("json")))


def trial_report_document(deltas: DataFrame, aggregate: DataFrame, runs: DataFrame | None = None, repo: str | None = None,
                          base: str | None = None, generated: str | None = None, most_trials: int = 10_000) -> DataFrame:
    """K2 as the one JSON document of a whole report: ``generated_at``, ``repo``,
    ``base``, ``trial_count``, ``trials`` in order, ``aggregate``, and the results
    once more where there is one trial.  The document is one row, so a report of more
    than ``most_trials`` trials is refused; ``trial_report_json`` has no bound."""
    n = deltas.select("trial").distinct().limit(most_trials + 1).count()
    if n > most_trials:
        raise ValueError(f"more than {most_trials} trials: write them with trial_report_json")
    listed = _trials(deltas, runs).agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", F.to_json("doc", _AS_JSON).alias("json")))),
                                                   lambda t: F.parse_json(t["json"])).alias("trials"))
    d = _aggregate(deltas, aggregate).join(listed, F.lit(True))                                          # one row each
    fields = [F.lit(generated).alias("generated_at"), F.lit(repo).alias("repo"), F.lit(base).alias("base"), F.col("trial_count"),
              F.coalesce("trials", F.array().cast("array<variant>")).alias("trials"), F.col("aggregate")]
    if runs is not None and n == 1:
        fields.append(F.variant_get(F.element_at("trials", 1), "$.results", "variant").alias("results"))
    return d.select(F.to_json(F.struct(*fields), _AS_JSON).alias("json"))


def write_trial_report(deltas: DataFrame, aggregate: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """K2 to a folder of JSON lines."""
    trial_report_json(deltas, aggregate, runs).select("json").write.mode("overwrite").text(path)


# Fixed wording of the report's tables.
TRIAL_HEAD = "| Trial | Order |" + "".join(f" {m} (baseline) | {m} (treatment) | Delta |" for m in ("Input Tokens", "Output Tokens", "Commands"))
AGGREGATE_HEAD = "| Metric | Mean | Median | Std Dev |"


def _rule(head: str) -> str:
    return "|" + "|".join(" " + "-" * len(cell.strip()) + " " for cell in head.strip("|").split("|")) + "|"


def trial_report_lines(deltas: DataFrame, aggregate: DataFrame, title: str = "Trial Results", repo: str | None = None,
                       base: str | None = None, generated: str | None = None) -> DataFrame:
    """K3, the whole document: (section, position, line) in document order:
    heading with repository, base, trial count and time of writing (those given), a
    row per trial, a row per metric."""
    spark = deltas.sparkSession
    head = [(2, f"**Repo:** `{repo}`  ", repo), (3, f"**Base:** `{base}`  ", base), (5, f"**Generated:** {generated}", generated)]
    fixed = spark.createDataFrame([
        (0, 0, f"# {title}"), (0, 1, ""), *((0, k, line) for k, line, given in head if given is not None), (0, 6, ""), (1, -4, "## Per-trial results"), (1, -3, ""), (1, -2, TRIAL_HEAD), (1, -1, _rule(TRIAL_HEAD)),
        (2, -5, ""), (2, -4, "## Aggregate (treatment vs baseline delta)"), (2, -3, ""), (2, -2, AGGREGATE_HEAD), (2, -1, _rule(AGGREGATE_HEAD))],
        "section int, position long, line string")
    count = deltas.agg(F.countDistinct("trial").alias("n")).select(
        F.lit(0).alias("section"), F.lit(4).cast("long").alias("position"),
        F.concat(F.lit("**Trials:** "), F.col("n").cast("string"), F.lit("  ")).alias("line"))
    trials = trial_report_rows(deltas).select(F.lit(1).alias("section"), F.col("trial").cast("long").alias("position"), F.col("row").alias("line"))
    order = F.coalesce(*[F.when(F.col("metric") == m, F.lit(i)) for i, (m, _) in enumerate(METRICS)])
    metrics = aggregate_report_rows(aggregate).select(F.lit(2).alias("section"), order.cast("long").alias("position"), F.col("row").alias("line"))
    return fixed.unionByName(count).unionByName(trials).unionByName(metrics)


def trial_report_rows(deltas: DataFrame) -> DataFrame:
    """K3: one markdown table row per trial: trial, order, then baseline,
    treatment and delta for each metric."""
    aggs = []
    for m, _ in METRICS:
        sel = F.col("metric") == m
        for f in ("baseline", "treatment", "delta_pct"):
            aggs.append(F.max_by(F.when(sel, F.col(f)), F.when(sel, F.lit(1))).alias(f"{m}_{f}"))
    wide = deltas.groupBy("trial", "order").agg(*aggs)
    cells = [F.col("trial").cast("string"), F.col("order")]
    for m, _ in METRICS:
        cells += [F.coalesce(F.col(f"{m}_baseline").cast("string"), F.lit("None")),
                  F.coalesce(F.col(f"{m}_treatment").cast("string"), F.lit("None")),
                  format_pct(F.col(f"{m}_delta_pct"))]
    return wide.select("trial", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def aggregate_report_rows(aggregate: DataFrame) -> DataFrame:
    """K3: aggregate table rows: metric label, mean, median, stdev in points."""
    sd = F.when(F.col("stdev_pct_points").isNull(), F.lit("n/a")) \
        .otherwise(F.format_string("%.1fpp", F.col("stdev_pct_points")))
    return aggregate.select("metric", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("label"), format_pct(F.col("mean_pct")),
                                                                          format_pct(F.col("median_pct")), sd),
                                                 F.lit(" |")).alias("row"))
