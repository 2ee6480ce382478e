"""T15 strategy dispatch and T16 metrics on line tables.

``compact`` takes a line table that carries each output's metadata on every
line (``output_id, line_no, line, command, args, full, binary``; only the first
three are required) and routes every output by the basename of its command:

* ``rg``/``grep``     -> search hits (T3, T4)
* ``git``             -> shape (T5): diff (T10, T11), log (T6), else unchanged
* ``fd``/``find``/``ls`` -> listing (T7-T9)
* ``cat``/``read``    -> file read: outline (T13, T14) for a ``.py`` last
  argument over 100 lines, else the document view (T12)
* anything else       -> run collapse + truncation (T1, T2)

Bypassed (``full``) and binary outputs pass through unchanged.  Extra
strategies can be registered per command: ``{"mytool": fn}`` with
``fn(lines) -> compacted`` (the reference's register decorator, as a mapping).
Each strategy reads only its slice; the results are one ``unionByName``.  Which
strategies the outputs ask for is looked up first (a distinct count over the command
column, a row per strategy), and only those are planned and run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .document import OUTLINE_THRESHOLD, document_view, outline
from .hits import compact_search_hits
from .lines import binary_flag, text_column
from .listing import compact_listing
from .runs import collapse_runs
from .scan import cut_parts, keeps_null_keys, materialize, unwrap_keys, wrap_key
from .vcs import cap_log_entries, classify_vcs, compact_diff

# Fixed command routing of the reference.
ROUTES = {"rg": "search", "grep": "search", "git": "vcs", "fd": "listing", "find": "listing", "ls": "listing",
          "cat": "file", "read": "file"}

D3 = ["output_id", "seq", "kind", "src_line_no", "line", "n_omitted"]


def basename(command):
    return F.substring_index(command, "/", -1)


def strategy_of(command, extra: Mapping[str, object] | None = None):
    b = basename(command)
    expr = F.lit("generic")
    for cmd in sorted(extra or {}):
        expr = F.when(b == cmd, F.lit("x:" + cmd)).otherwise(expr)
    for strat in sorted(set(ROUTES.values())):
        expr = F.when(b.isin([c for c, s in ROUTES.items() if s == strat and c not in (extra or {})]), F.lit(strat)).otherwise(expr)
    return expr


def _unchanged(lines: DataFrame) -> DataFrame:
    return lines.select("output_id", F.col("line_no").cast("long").alias("seq"), F.lit("line").alias("kind"),
                        F.col("line_no").cast("int").alias("src_line_no"), "line",
                        F.lit(0).cast("long").alias("n_omitted"))


def compacted_sizes(compacted: DataFrame) -> DataFrame:
    """What T16 needs of compacted rows: lines and bytes out per output."""
    return compacted.groupBy("output_id").agg(F.count(F.lit(1)).alias("lines_out"), *_sizes())


def _sizes() -> list:
    return [F.sum(F.octet_length("line")).cast("long").alias("_bytes"), F.sum(F.length("line")).cast("long").alias("_chars")]


# Commands of a table that are named in the filters of its strategies.
_FEW_COMMANDS = 1 << 8
# Outputs of a shape that are looked up in every task instead of being joined.
_FEW_OUTPUTS = 1 << 15


@keeps_null_keys("lines")
def compact(lines: DataFrame, strategies: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
            options: Mapping[str, Mapping[str, object]] | None = None,
            each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Compacted rows (D3) for every output of ``lines``, which every strategy
    reads more than once: best a table (``cut``).

    ``options`` are keyword arguments by strategy: ``generic``, ``search``,
    ``listing``, ``diff``, ``log``, ``outline`` and ``view`` take those of their
    operator, ``file`` takes ``outline_threshold``.

    ``each`` is what is wanted of a strategy's rows (``compacted_sizes``): it is
    computed of one strategy after another and written, and what a strategy has
    persisted, cut and shuffled is freed before the next.  The result is the union.
    """
    o = {k: dict(v) for k, v in (options or {}).items()}
    threshold = o.get("file", {}).get("outline_threshold", OUTLINE_THRESHOLD)
    cols = set(lines.columns)
    d = lines
    if "command" not in cols:
        d = d.withColumn("command", F.lit(None).cast("string"))
    if "args" not in cols:
        d = d.withColumn("args", F.array().cast("array<string>"))
    skip = F.lit(False)
    if "full" in cols:
        skip = skip | F.coalesce(F.col("full"), F.lit(False))
    if "binary" in cols:
        skip = skip | F.coalesce(F.col("binary"), F.lit(False))
    d = d.withColumn("_strategy", F.when(skip, F.lit("bypass")).otherwise(strategy_of(F.col("command"), strategies)))
    base = ["output_id", "line_no", "line"]

    # few commands are named, so that a parquet table is not read where others lie
    routed = d.select("_strategy", "command").distinct().limit(_FEW_COMMANDS + 1).collect()
    few = len(routed) <= _FEW_COMMANDS
    asked = {r[0] for r in (routed if few else d.select("_strategy").distinct().collect())}

    def part(name):
        mine = d.where(F.col("_strategy") == name)
        if few:
            commands = [r[1] for r in routed if r[0] == name]
            named = F.col("command").isin([c for c in commands if c is not None])
            mine = mine.where(named | F.col("command").isNull() if None in commands else named)
        return mine

    def diffs(here: bool) -> DataFrame:
        """The version-control lines of diffs, or of all other outputs."""
        return part("vcs").select(*base).join(diff_ids, "output_id", "left_semi" if here else "left_anti")

    def files(big_ones: bool) -> DataFrame:
        lf = part("file")
        meta = (lf.groupBy("output_id")
                .agg(F.count(F.lit(1)).alias("_n"), F.first("args", ignorenulls=True).alias("_args")))
        has_arg = F.size(F.coalesce("_args", F.array().cast("array<string>"))) > 0
        meta = meta.select("output_id", F.when(has_arg, F.element_at("_args", -1)).alias("filename"),
                           F.when(has_arg, F.col("_n")).alias("total_lines"))
        big = F.coalesce(F.col("filename").endswith(".py") & (F.col("total_lines") > threshold), F.lit(False))
        mine = meta.where(big if big_ones else ~big)
        fl = lf.select(*base).join(mine.select("output_id"), "output_id")
        return outline(fl, mine, **o.get("outline", {})) if big_ones else document_view(fl, mine, **o.get("view", {}))

    out = [lambda: _unchanged(part("bypass").select(*base))]
    if "generic" in asked:
        out.append(lambda: collapse_runs(part("generic").select(*base), **o.get("generic", {})))
    if "search" in asked:
        out.append(lambda: compact_search_hits(part("search").select(*base), **o.get("search", {})))
    if "listing" in asked:
        out.append(lambda: compact_listing(part("listing").select(*base), **o.get("listing", {})))
    if "vcs" in asked:
        diff_ids = materialize(classify_vcs(part("vcs")).where(F.col("shape") == "diff").select("output_id"))
        diff_ids = F.broadcast(diff_ids) if diff_ids.count() <= _FEW_OUTPUTS else diff_ids
        # the scan of the logs tells the shape of outputs that are no diffs
        out += [lambda: compact_diff(diffs(True), leaf=True, **o.get("diff", {})),
                lambda: cap_log_entries(diffs(False), leaf=True, shaped=False, **o.get("log", {}))]
    if "file" in asked:
        out += [lambda: files(True), lambda: files(False)]
    for cmd, fn in sorted((strategies or {}).items()):
        if f"x:{cmd}" in asked:
            out.append(lambda cmd=cmd, fn=fn: wrap_key(fn(unwrap_keys(part("x:" + cmd).select(*base))).select(*D3), "output_id"))

    if each is not None:
        return cut_parts(lines.sparkSession, [lambda f=f: each(f().select(*D3)) for f in out])
    res = out[0]().select(*D3)
    for f in out[1:]:
        res = res.unionByName(f().select(*D3))
    return res


def outputs_to_lines(outputs: DataFrame, key: str = "output_id") -> DataFrame:
    """T0 on blob outputs: lines carrying command, args, full, the E2 binary flag
    and whether the output came as bytes (``binary_source``)."""
    from .lines import is_binary_column, to_lines
    cols = {"binary": binary_flag(outputs), "binary_source": F.lit(is_binary_column(outputs))}
    if "full" not in outputs.columns:
        cols["full"] = F.lit(False)
    o = outputs.withColumns(cols)
    keep = tuple(c for c in ("command", "args", "full", "binary", "binary_source") if c in o.columns)
    return to_lines(o, key=key, keep=keep)


def line_metrics(lines: DataFrame, compacted: DataFrame, outputs: DataFrame | None = None, key: str = "output_id") -> DataFrame:
    """T16 from a line table: the invocation facts per output (lines and bytes
    in and out, ``compressed_lines`` NULL when unchanged, ``full``).  ``compacted`` are
    rows, or their ``compacted_sizes``, of which an output may have several.

    A line table has no rows of an empty or missing output; with ``outputs`` each
    of them is a row, as the log has every call.  Lines of an output that came as
    bytes hold one character per byte."""
    cols = set(lines.columns)
    source = F.max(F.coalesce("binary_source", F.lit(False))) if "binary_source" in cols else F.lit(False)
    meta = [F.first("command", ignorenulls=True).alias("command")] if "command" in cols else []
    if "full" in cols:
        meta.append(F.max(F.coalesce("full", F.lit(False))).alias("full"))
    raw = lines.groupBy("output_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if(F.col("line").endswith("\n")).alias("stdout_lines"),
        *_sizes(), source.alias("_source"), *meta)
    raw = raw.withColumn("stdout_bytes", F.when(F.col("_source"), F.col("_chars")).otherwise(F.col("_bytes"))).drop("_bytes", "_chars")
    if outputs is not None:
        given = [F.col(key).alias("output_id"), *[F.col(c) for c in ("command", "full") if c in outputs.columns]]
        known = [c for c in ("command", "full") if c in outputs.columns]
        raw = outputs.select(*given).join(raw.drop(*known).withColumnRenamed("output_id", "_oid"), F.col("output_id").eqNullSafe(F.col("_oid")), "left") \
            .drop("_oid").fillna(0, ["line_count", "stdout_lines", "stdout_bytes"])
    sizes = compacted if "lines_out" in compacted.columns else compacted_sizes(compacted)
    out = sizes.groupBy(F.col("output_id").alias("_oid")).agg(*[F.sum(c).alias(c) for c in ("lines_out", "_bytes", "_chars")])
    zero = F.lit(0).cast("long")
    d = raw.join(out, F.col("output_id").eqNullSafe(F.col("_oid")), "left").withColumns({
        "lines_out": F.coalesce("lines_out", zero),
        "bytes_out": F.coalesce(F.when(F.col("_source"), F.col("_chars")).otherwise(F.col("_bytes")), zero)})
    d = d.drop("_oid", "_source", "_bytes", "_chars")
    full = F.coalesce(F.col("full"), F.lit(False)) if "full" in d.columns else F.lit(False)
    return d.withColumns({
        "compressed_lines": F.when(~full & (F.col("lines_out") != F.col("line_count")), F.col("lines_out")),
        "full": full})


__all__ = ["compact", "compacted_sizes", "outputs_to_lines", "line_metrics", "strategy_of", "ROUTES", "text_column"]
