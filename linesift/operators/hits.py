"""Search-hit compaction (T3) and per-file omission notes (T4).

Input: lines of ``rg``/``grep`` output.  A terminator-stripped line is a
separator (``--``), a hit ``file:n:text``, a context line ``file:n-text`` (the
hit test runs first) or anything else.  Per (output, file) the first ``cap``
distinct hit texts (whitespace-trimmed) are kept; repeats of a kept text are
duplicates; all other hits are over the cap.  Separators survive only before a
kept hit; context lines only when they are among the last ``context`` lines
before the next event and that event is a kept hit, or a separator / other
line / the end not preceded by a dropped hit.

Plan (no window over a whole output or file):
* distinct (output, file, text) keys by aggregation, their rank among the
  file's keys by a two-level scan over first-seen position;
* keys joined back to hits -> kept / dropped;
* previous / next event of every line by two-level scans over the output
  (events encoded as ``line_no * 8 + kind``, so max/min give nearest events);
* result position = running count of kept rows (two-level scan), joined with their lines;
* notes: one aggregate per (output, file); the line-number hint takes at most
  10 over-cap hits per file with a row_number limit (WindowGroupLimit before
  the shuffle), never the whole list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import eol_strip, ws_strip
from .compare import DEFAULT_MARKER
from .scan import CHUNK_COL, DEFAULT_CHUNK_ROWS, cut, keeps_null_keys, segmented_scan

# Fixed values that must equal the reference's for equal results.
MATCH_CAP = 5
CONTEXT_LINES = 2
LINE_HINTS = 10
HIT_RE = "(?s)^(.+?):(\\d+):(.*)"
CONTEXT_RE = "(?s)^(.+?):(\\d+)-(.*)"

K, D, S, O = 1, 2, 3, 4      # event kinds: kept hit, dropped hit, separator, other line


def classify_hits(lines: DataFrame, key: str = "output_id") -> DataFrame:
    """Parse every line: ``kind`` in ('sep', 'hit', 'ctx', 'other'), hit fields."""
    raw = eol_strip(F.col("line"))
    is_hit = raw.rlike(HIT_RE)
    kind = (F.when(raw == "--", "sep").when(is_hit, "hit").when(raw.rlike(CONTEXT_RE), "ctx").otherwise("other"))
    return lines.select(
        F.col(key).alias("output_id"), "line_no", "line", kind.alias("kind"),
        F.when(is_hit, F.regexp_extract(raw, HIT_RE, 1)).alias("file"),
        F.when(is_hit, F.regexp_extract(raw, HIT_RE, 2).try_cast("long")).alias("hit_n"),
        F.when(is_hit, ws_strip(F.regexp_extract(raw, HIT_RE, 3))).alias("text_key"))


@keeps_null_keys("classified")
def hit_status(classified: DataFrame, cap: int = MATCH_CAP, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Hits with ``rank`` (of their text among the file's distinct texts),
    ``first`` and ``status`` ('kept', 'duplicate', 'over_cap')."""
    hits = classified.where(F.col("kind") == "hit").select("output_id", "line_no", "file", "hit_n", "text_key")
    keys = hits.groupBy("output_id", "file", "text_key").agg(F.min("line_no").alias("first_ln"))
    keys = segmented_scan(keys, ["output_id", "file"], "first_ln", chunk_rows=chunk_rows,
                          running_sum={"rank": F.lit(1)}).drop(CHUNK_COL)
    h = hits.join(keys, ["output_id", "file", "text_key"])
    first = F.col("line_no") == F.col("first_ln")
    status = (F.when(F.col("rank") > cap, "over_cap").when(first, "kept").otherwise("duplicate"))
    return h.withColumns({"first": first, "status": status})


@keeps_null_keys("lines")
def compact_search_hits(lines: DataFrame, cap: int = MATCH_CAP, context: int = CONTEXT_LINES,
                        key: str = "output_id", marker: str = DEFAULT_MARKER,
                        chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """T3 + T4: lines -> compacted rows (D3): kept lines in order, then one
    note per file with omitted hits, in order of the file's first hit."""
    # one leaf read by the scans below; a hash stands for a hit's text, and a row number
    # for the line, so that no text is shuffled before it is known which lines are kept
    c = cut(classify_hits(lines, key).withColumns({"text_key": F.md5("text_key"), "_row": F.monotonically_increasing_id()}))
    st = hit_status(c, cap, chunk_rows)
    d = c.select("output_id", "line_no", "kind", "file", "hit_n", "_row") \
        .join(st.select("output_id", "line_no", "status"), ["output_id", "line_no"], "left")
    ev = (F.when(F.col("kind") == "sep", S).when(F.col("kind") == "other", O)
          .when(F.col("status") == "kept", K).when(F.col("kind") == "hit", D))
    code = F.col("line_no").cast("long") * 8 + ev
    d = d.withColumn("_ev", ev)
    d = segmented_scan(d, ["output_id"], "line_no", chunk_rows=chunk_rows,
                       running_max={"_prev": code},
                       next_min={"_next": code, "_next_nd": F.when(F.col("_ev") != D, code)},
                       total_sum={"_n": F.lit(1)}).drop(CHUNK_COL)
    nxt = F.col("_next") % 8
    nxt_pos = F.coalesce(F.floor(F.col("_next") / 8), F.col("_n") + 0)
    last_of_run = (nxt_pos - F.col("line_no")) <= F.lit(context)
    prev_not_d = F.col("_prev").isNull() | ((F.col("_prev") % 8) != D)
    keep_ctx = (F.col("kind") == "ctx") & last_of_run & (
        (nxt == K) | ((F.col("_next").isNull() | nxt.isin(S, O)) & prev_not_d))
    keep = ((F.col("_ev") == K) | (F.col("_ev") == O) | ((F.col("_ev") == S) & ((F.col("_next_nd") % 8) == K))
            | keep_ctx)
    # one leaf for the kept-row scan and the per-file notes
    e = cut(d.select("output_id", "line_no", "kind", "file", "hit_n", "status", "_row", keep.alias("_keep")))
    kept = segmented_scan(e.where("_keep").select("output_id", "line_no", "_row"), ["output_id"], "line_no",
                          chunk_rows=chunk_rows, running_sum={"_cum": F.lit(1)}).drop(CHUNK_COL)
    kept = kept.join(c.select("_row", "line"), "_row")
    body = kept.select("output_id", (F.col("_cum") - 1).cast("long").alias("seq"), F.lit("line").alias("kind"),
                       F.col("line_no").alias("src_line_no"), "line", F.lit(0).cast("long").alias("n_omitted"))

    notes = search_hit_summary(e.where(F.col("kind") == "hit"), marker).where(F.col("omitted") > 0)
    totals = e.groupBy("output_id").agg(F.count_if("_keep").alias("_total"))
    nrank = F.row_number().over(Window.partitionBy("output_id").orderBy("first_hit_line"))
    notes = (notes.join(totals, "output_id", "left")
             .select("output_id", (F.coalesce("_total", F.lit(0)) + nrank - 1).cast("long").alias("seq"),
                     F.lit("note").alias("kind"), F.lit(None).cast("int").alias("src_line_no"),
                     F.col("note").alias("line"), F.col("omitted").cast("long").alias("n_omitted")))
    return body.unionByName(notes)


@keeps_null_keys("status")
def search_hit_summary(status: DataFrame, marker: str = DEFAULT_MARKER, hints: int = LINE_HINTS) -> DataFrame:
    """T4: per (output, file): kept/total, duplicates, over-cap count, the first
    ``hints`` over-cap line numbers with "(+k more)", and the note text."""
    agg = status.groupBy("output_id", "file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "kept").alias("kept"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "over_cap").alias("over_cap"),
        F.min("line_no").alias("first_hit_line"))
    over = status.where(F.col("status") == "over_cap")
    w = Window.partitionBy("output_id", "file").orderBy("line_no")
    first_over = (over.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hints)
                  .groupBy("output_id", "file")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "hit_n"))),
                                                lambda x: x["hit_n"].cast("string")), ", ").alias("_hint")))
    d = agg.join(first_over, ["output_id", "file"], "left")
    hint = F.concat(F.col("_hint"), F.when(F.col("over_cap") > hints,
                                           F.concat(F.lit(" (+"), (F.col("over_cap") - hints).cast("string"),
                                                    F.lit(" more)"))).otherwise(F.lit("")))
    reasons = F.concat_ws(", ",
                          F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"),
                                                                   F.lit(" duplicate"))),
                          F.when(F.col("over_cap") > 0, F.concat(F.col("over_cap").cast("string"),
                                                                 F.lit(" over cap at lines "), hint)))
    omitted = F.col("total") - F.col("kept")
    note = F.concat(F.lit(marker + " "), F.col("file"), F.lit(" kept "), F.col("kept").cast("string"), F.lit("/"),
                    F.col("total").cast("string"), F.lit(" matches; "), omitted.cast("string"),
                    F.lit(" more matches omitted"),
                    F.when(reasons != "", F.concat(F.lit(" ("), reasons, F.lit(")"))).otherwise(F.lit("")),
                    F.lit("\n"))
    return d.select("output_id", "file", "total", "kept", "duplicates", "over_cap", omitted.alias("omitted"),
                    F.coalesce(F.col("_hint"), F.lit("")).alias("over_cap_lines"), "first_hit_line",
                    note.alias("note"))
