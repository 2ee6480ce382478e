"""T1 run collapse and T2 head truncation (the generic strategy).

T1: a run of more than ``threshold`` consecutive equal lines (terminator
included) becomes its first line plus the note ``# ... repeated N times``.
T2: the compacted sequence is cut at ``limit`` rows (notes included) and the
note ``# ... K more lines truncated`` follows.

Plan (one shuffle of the line table, no window over a whole output):

* rows are chunked by ``(output_id, line_no div chunk_rows)``; the last row of
  each chunk is also sent, flagged as a *ghost*, to the next chunk, so the
  previous line is an in-chunk ``lag``;
* in-chunk windows give the run starts, the next start and the *excess* of
  every run closed inside the chunk (a collapsed run of length L emits 2 rows,
  so it removes L - 2);
* a per-chunk summary (one row per chunk) resolves runs that cross chunks and
  the excess carried from earlier chunks; it is joined back once;
* a kept row's result position is ``line_no - (excess of the runs before it)``;
  one ``explode`` then emits 0-3 result rows per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK_COL, DEFAULT_CHUNK_ROWS, materialize, null_safe_keys

# Fixed values that must equal the reference's for equal results.
REPEAT_THRESHOLD = 3
GENERIC_LIMIT = 200
REPEAT_NOTE = "# ... repeated {n} times\n"
TRUNCATE_NOTE = "# ... {n} more lines truncated\n"

COMPACTED_COLS = ["output_id", "seq", "kind", "src_line_no", "line", "n_omitted"]


def note_text(template: str, n: F.Column) -> F.Column:
    head, tail = template.split("{n}")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def with_ghosts(lines: DataFrame, chunk_rows: int, key: str = "output_id", pos: str = "line_no") -> tuple[DataFrame, list[str]]:
    """Chunk the rows and copy each chunk's last row into the next chunk as a
    ghost (``_ghost = true``), then hash-partition by ``(key, chunk)``.
    Positions must be dense (0..n-1).  Also returns the non-null key columns."""
    chunk = F.floor(F.col(pos) / F.lit(chunk_rows)).cast("long")
    last = (F.col(pos) % F.lit(chunk_rows)) == F.lit(chunk_rows - 1)
    me = F.struct(chunk.alias("c"), F.lit(False).alias("g"))
    nxt = F.struct((chunk + 1).alias("c"), F.lit(True).alias("g"))
    d = lines.withColumn("_cg", F.explode(F.when(last, F.array(me, nxt)).otherwise(F.array(me))))
    d = d.withColumns({CHUNK_COL: F.col("_cg.c"), "_ghost": F.col("_cg.g")}).drop("_cg")
    d, keys = null_safe_keys(d, [key])
    return d.repartition(*keys, CHUNK_COL), keys


def collapse_runs(lines: DataFrame, threshold: int = REPEAT_THRESHOLD, limit: int | None = GENERIC_LIMIT,
                  key: str = "output_id", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """T1 (+ T2 when ``limit`` is not None): lines -> compacted rows (D3)."""
    d, keys = with_ghosts(lines.select(F.col(key).alias("output_id"), "line_no", "line"), chunk_rows)
    wc = Window.partitionBy(*keys, CHUNK_COL).orderBy("line_no")
    # "rows after this one" as a growing frame of the descending order: Spark
    # evaluates shrinking (unbounded following) frames in O(n^2).
    wd = Window.partitionBy(*keys, CHUNK_COL).orderBy(F.col("line_no").desc())
    real = ~F.col("_ghost")
    prev = F.lag("line").over(wc)
    d = d.withColumn("_start", F.when(real & (prev.isNull() | (prev != F.col("line"))), F.col("line_no")))
    d = d.withColumns({
        "_pm": F.max("_start").over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_nm": F.min("_start").over(wd.rowsBetween(Window.unboundedPreceding, -1)),
    })
    closed_len = F.col("_nm") - F.col("_start")
    d = d.withColumn("_xs", F.when(F.col("_start").isNotNull() & (closed_len > threshold), closed_len - 2)
                     .otherwise(F.lit(0)))
    d = d.withColumn("_xb", F.coalesce(
        F.sum("_xs").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = materialize(d.where(real))        # read by the summary and the main branch

    summ = (d.groupBy(*keys, CHUNK_COL)
            .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_start").alias("_fs"), F.max("_start").alias("_ls"),
                 F.sum("_xs").alias("_inner")))
    wk = Window.partitionBy(*keys).orderBy(CHUNK_COL)
    wkd = Window.partitionBy(*keys).orderBy(F.col(CHUNK_COL).desc())
    summ = summ.withColumns({
        "_c_pm": F.max("_ls").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
        "_c_nm": F.min("_fs").over(wkd.rowsBetween(Window.unboundedPreceding, -1)),
        "_n": F.sum("_cnt").over(Window.partitionBy(*keys)),
    })
    tail_len = F.coalesce(F.col("_c_nm"), F.col("_n")) - F.col("_ls")
    summ = summ.withColumn("_cx", F.col("_inner") + F.when(F.col("_ls").isNotNull() & (tail_len > threshold),
                                                           tail_len - 2).otherwise(F.lit(0)))
    summ = summ.withColumns({
        "_c_x": F.coalesce(F.sum("_cx").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_t_x": F.sum("_cx").over(Window.partitionBy(*keys)),
    }).select(*keys, CHUNK_COL, "_c_pm", "_c_nm", "_n", "_c_x", "_t_x")

    d = d.join(summ, [*keys, CHUNK_COL])
    run_start = F.coalesce(F.col("_pm"), F.col("_c_pm"))
    run_len = F.coalesce(F.col("_nm"), F.col("_c_nm"), F.col("_n")) - run_start
    k = F.col("line_no") - run_start
    collapsed = run_len > threshold
    seq = F.col("line_no") - F.col("_c_x") - F.col("_xb")
    total = F.col("_n") - F.col("_t_x")

    def row(keep, seq_, kind, src, text, omitted):
        return F.struct(keep.alias("keep"), seq_.cast("long").alias("seq"), F.lit(kind).alias("kind"),
                        src.cast("int").alias("src_line_no"), text.alias("line"),
                        omitted.cast("long").alias("n_omitted"))

    within = (lambda s: s < F.lit(limit)) if limit is not None else (lambda s: F.lit(True))
    cands = [
        row((~collapsed | (k == 0)) & within(seq), seq, "line", F.col("line_no"), F.col("line"), F.lit(0)),
        row(collapsed & (k == 0) & within(seq + 1), seq + 1, "note", F.col("line_no"),
            note_text(REPEAT_NOTE, run_len), run_len - 1),
    ]
    if limit is not None:
        over = total - F.lit(limit)
        cands.append(row((F.col("line_no") == 0) & (over > 0), F.lit(limit), "note", F.lit(None),
                         note_text(TRUNCATE_NOTE, over), over))
    out = d.select("output_id", F.explode(F.filter(F.array(*cands), lambda r: r["keep"])).alias("r"))
    return out.select("output_id", "r.seq", "r.kind", "r.src_line_no", "r.line", "r.n_omitted")


def truncate_tail(compacted: DataFrame, limit: int = GENERIC_LIMIT, key: str = "output_id") -> DataFrame:
    """T2 alone on any compacted table: keep rows with seq < limit, add the note.

    ``seq`` must be dense 0..n-1 per output (as every operator here emits), so the
    kept rows are a filter that reaches the scan; only counts are shuffled.
    """
    over = F.count(F.lit(1)) - F.lit(limit)
    notes = compacted.groupBy(key).agg(over.alias("_over")).where(F.col("_over") > 0).select(
        F.col(key), F.lit(limit).cast("long").alias("seq"), F.lit("note").alias("kind"), F.lit(None).cast("int").alias("src_line_no"),
        note_text(TRUNCATE_NOTE, F.col("_over")).alias("line"), F.col("_over").cast("long").alias("n_omitted"))
    return compacted.where(F.col("seq") < limit).select(*notes.columns).unionByName(notes)
