"""Version-control output: shape dispatch (T5), commit-log cap (T6), diff
metadata strip (T10) and diff hunk compaction (T11).

All operators take a line table ``(output_id, line_no, line)`` with dense
``line_no`` and return compacted rows (D3).  Per-output facts are hash
aggregates joined back; ordered state uses the two-level scans of ``scan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_commit_header, is_oneline_commit, strip_graph, ws_strip
from .compare import DEFAULT_MARKER
from .scan import CHUNK_COL, DEFAULT_CHUNK_ROWS, keeps_null_keys, materialize, segmented_scan

# Fixed values that must equal the reference's for equal results.
LOG_MAX_ENTRIES = 20
DIFF_DETECT_LINES = 20
LOG_DETECT_LINES = 10
GRAPH_DETECT_LINES = 15


def _d3(df: DataFrame, seq, kind: str, src, line, omitted) -> DataFrame:
    return df.select("output_id", seq.cast("long").alias("seq"), F.lit(kind).alias("kind"),
                     src.cast("int").alias("src_line_no"), line.alias("line"), omitted.cast("long").alias("n_omitted"))


def _own(lines: DataFrame, key: str) -> DataFrame:
    """The line table alone, with its chunk column if it has been dealt by one."""
    return lines.select(F.col(key).alias("output_id"), "line_no", "line", *([CHUNK_COL] if CHUNK_COL in lines.columns else []))


def is_log_line(line) -> F.Column:
    s = strip_graph(line)
    return is_commit_header(s) | is_oneline_commit(s)


def classify_vcs(lines: DataFrame, key: str = "output_id") -> DataFrame:
    """T5: ``shape`` per output: 'diff' if one of the first 20 lines starts with
    ``diff --git`` or ``--- ``; else 'log' if one of the first 10 lines starts a
    commit entry (after graph decoration); else 'other'."""
    diff, log = _shape_flags()
    agg = lines.where(F.col("line_no") < DIFF_DETECT_LINES).groupBy(F.col(key).alias("output_id")) \
        .agg(F.max(diff).alias("_d"), F.max(log).alias("_l"))
    return agg.select("output_id", _shape().alias("shape"))


def _shape_flags() -> tuple[F.Column, F.Column]:
    l = F.col("line")
    diff = (F.col("line_no") < DIFF_DETECT_LINES) & (l.startswith("diff --git") | l.startswith("--- "))
    log = (F.col("line_no") < LOG_DETECT_LINES) & is_log_line(l)
    return diff, log


def _shape() -> F.Column:
    return F.when(F.col("_d"), "diff").when(F.col("_l"), "log").otherwise("other")


@keeps_null_keys("lines")
def deal_by_shape(lines: DataFrame, key: str = "output_id", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """T5 on every line: its output's ``shape`` beside it, the lines dealt to chunks
    (``_chunk``) as ``compact_diff`` and ``cap_log_entries`` take them, so that they
    are neither joined with the shapes nor shuffled again."""
    diff, log = _shape_flags()
    d = segmented_scan(_own(lines, key), ["output_id"], "line_no", chunk_rows=chunk_rows, total_max={"_d": diff, "_l": log})
    return d.withColumn("shape", _shape()).drop("_d", "_l")


@keeps_null_keys("lines")
def cap_log_entries(lines: DataFrame, max_entries: int = LOG_MAX_ENTRIES, key: str = "output_id",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, leaf: bool = False, shaped: bool = True) -> DataFrame:
    """Keep the first ``max_entries`` commit entries with all their lines.

    The format is fixed by the first line that is not blank after removing
    graph decoration: ``commit <sha>`` (standard/stat) or ``<sha> <msg>``
    (one-line).  A graph is any decorated, non-blank, non-``commit`` line in
    the first 15.  Pure one-line logs keep their first ``max_entries`` lines;
    otherwise a line is kept while the running count of entry starts (one-line
    starts for decorated one-line logs, ``commit <sha>`` otherwise) is within
    the cap.  No note is written.  Kept rows are always a prefix, so ``seq`` is
    the line number.

    ``leaf``: lines are a table that may be read twice, and are not persisted.  Without
    ``shaped``, outputs may have other shapes than a log (T5): the same scan tells them,
    an output of no shape stays as it is, and diffs go.
    """
    d = _own(lines, key)
    stripped = strip_graph(F.col("line"))
    nonblank = ws_strip(stripped) != ""
    raw_strip = ws_strip(F.col("line"))
    graph = ((F.col("line_no") < GRAPH_DETECT_LINES) & F.col("line").rlike("^[*|/\\\\ ]")
             & (raw_strip != "") & ~raw_strip.startswith("commit "))
    # the first worded line is the greatest by falling line number
    first = F.when(nonblank, F.struct((-F.col("line_no")).alias("at"), is_commit_header(stripped).alias("std"),
                                      is_oneline_commit(stripped).alias("one")))
    dealt = CHUNK_COL in lines.columns
    shape = {} if shaped else dict(zip(("_d", "_l"), _shape_flags()))
    d = segmented_scan(d, ["output_id"], "line_no", chunk_rows=chunk_rows, dealt=dealt, leaf=leaf and not dealt,
                       running_sum={"_headers": is_commit_header(stripped).cast("int"),
                                    "_onelines": is_oneline_commit(stripped).cast("int")},
                       total_max={"_first": first, "_graph": graph} | shape).drop(CHUNK_COL)
    d = d.withColumns({"_std": F.col("_first.std"), "_one": F.col("_first.one") & ~F.col("_first.std")})
    d = d.withColumn("_entries", F.when(F.col("_one") & F.col("_graph"), F.col("_onelines")).otherwise(F.col("_headers")))
    keep = (F.col("_std").isNull()                                   # nothing but blank lines: unchanged
            | F.when(F.col("_one") & ~F.col("_graph"), F.col("line_no") < max_entries)
            .otherwise(F.col("_entries") <= max_entries))
    if not shaped:
        keep = F.when(_shape() == "log", keep).otherwise(_shape() == "other")
    return _d3(d.where(keep), F.col("line_no"), "line", F.col("line_no"), F.col("line"), F.lit(0))


# Fixed values of the diff strategy.
DIFF_MIN_HUNK = 20
DIFF_CONTEXT = 3
DIFF_MULTIFILE = 3
HUNK_HEADER_RE = "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@"
FILES_NOTE = "{marker} {n} files changed — file headers compressed\n"


@keeps_null_keys("lines")
def compact_diff(lines: DataFrame, min_hunk: int = DIFF_MIN_HUNK, context: int = DIFF_CONTEXT,
                 multifile: int = DIFF_MULTIFILE, key: str = "output_id", marker: str = DEFAULT_MARKER,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, leaf: bool = False) -> DataFrame:
    """T10 + T11 on diff outputs.

    T10: ``index ..`` lines are dropped; ``@@`` opens a hunk that only
    ``diff --git`` closes (so ``--- ``/``+++ `` inside a hunk are body); with
    more than ``multifile`` files the ``--- ``/``+++ `` headers outside hunks go
    and a file-count note leads.  T11: a hunk of more than ``min_hunk`` body
    lines keeps the lines within ``context`` of a change (``+``/``-``; a ``\\ ``
    line marks itself and its predecessor); a gap of unkept lines that all start
    with a space becomes ``... (N lines omitted, lines a-b)`` in new-file
    numbering, any other gap is kept whole.

    Lines with a ``_chunk`` column come dealt by an earlier scan over their outputs.
    ``leaf``: lines are a table that may be read twice, and are persisted once only.

    No window spans a hunk or an output, and lines are dealt once: three scans over
    the same chunks give the position among the lines that are not dropped and the
    current hunk, then the nearest change, hunk end and line without a leading space
    on either side, and last the place in the output.  What is known of a hunk or a
    gap follows from these: consecutive body lines have consecutive positions, so a
    gap reaches from ``context`` after the change before it (or the hunk's start) to
    ``context`` before the next (or the hunk's end).
    """
    l = F.col("line")
    d = _own(lines, key)
    idx_drop = l.startswith("index ") & (F.instr(l, "..") > 0)
    is_hh = ~idx_drop & l.startswith("@@")
    is_dg = ~idx_drop & ~is_hh & l.startswith("diff --git")
    adv = ~idx_drop & ~l.startswith("-")
    dealt = CHUNK_COL in lines.columns
    d = segmented_scan(d, ["output_id"], "line_no", chunk_rows=chunk_rows, dealt=dealt, leaf=leaf and not dealt,
                       running_max={"_last": F.when(is_hh, F.col("line_no").cast("long") * 2 + 1)
                                    .when(is_dg, F.col("line_no").cast("long") * 2)},
                       running_sum={"_p": (~idx_drop).cast("int"), "_advc": adv.cast("int")},
                       total_sum={"_files": l.startswith("diff --git ").cast("int"), "_n": (~idx_drop).cast("int")})
    files = d.where(F.col("line_no") == 0).select("output_id", F.col("_files").alias("_f"))
    d = materialize(d.where(~idx_drop))       # read by the next scans' summaries and the rows
    in_hunk = F.coalesce((F.col("_last") % 2) == 1, F.lit(False))
    body = in_hunk & ~is_hh
    compress_headers = F.col("_files") > multifile

    x = F.col("_p")
    nonl = l.startswith("\\ ")
    change = l.startswith("+") | l.startswith("-") | nonl
    space = l.startswith(" ")
    new_start = F.regexp_extract("line", HUNK_HEADER_RE, 1)
    head = F.struct(x.alias("p"), F.col("_advc").alias("adv"), F.when(new_start != "", new_start.try_cast("long")).alias("ns"))
    d = segmented_scan(d, ["output_id"], "_p", dealt=True,
                       running_max={"_head": F.when(is_hh, head), "_li0": F.when(change, x), "_lw": F.when(~space, x)},
                       next_min={"_ni0": F.when(change, x), "_nn": F.when(nonl, x), "_nw": F.when(~space, x),
                                 "_end": F.when(is_hh | is_dg, x)})
    hs = F.col("_head.p") + 1
    he = F.coalesce(F.col("_end") - 1, F.col("_n"))
    before_nonl = F.coalesce((F.col("_nn") == x + 1) & (F.col("_nn") <= he), F.lit(False))
    li = F.when(change | before_nonl, x).otherwise(F.col("_li0"))
    ni = F.when(change | before_nonl, x).otherwise(
        F.least(F.col("_ni0"), F.when(F.col("_nn") <= he, F.col("_nn") - 1)))
    d = d.withColumns({"_body": body, "_in": in_hunk, "_hs": hs, "_he": he, "_li": F.when(li >= hs, li), "_ni": F.when(ni <= he, ni)})
    li, ni, hs, he = F.col("_li"), F.col("_ni"), F.col("_hs"), F.col("_he")
    kept = F.coalesce(x - li <= context, F.lit(False)) | F.coalesce(ni - x <= context, F.lit(False))
    first = F.coalesce(li + (context + 1), hs)
    last = F.coalesce(ni - (context + 1), he)
    blank = ~(F.coalesce(F.col("_lw") >= first, F.lit(False)) | F.coalesce(F.col("_nw") <= last, F.lit(False)))
    cuts = (he - hs + 1 > min_hunk) & (li.isNotNull() | ni.isNotNull()) & ~kept & blank
    d = d.withColumns({"_glen": last - first + 1, "_cuts": cuts, "_lead": x == first, "_ns": F.col("_head.ns"),
                       "_adv0": F.col("_head.adv")})
    a = F.col("_ns") + F.col("_advc") - adv.cast("int") - F.col("_adv0")
    rng = F.when(F.col("_ns").isNotNull(), F.concat(F.lit(", lines "), a.cast("string"), F.lit("-"),
                                                    (a + F.col("_glen") - 1).cast("string"))).otherwise(F.lit(""))
    gap_note = F.concat(F.lit("... ("), F.col("_glen").cast("string"), F.lit(" lines omitted"), rng, F.lit(")\n"))
    hdr_drop = compress_headers & ~F.col("_in") & (l.startswith("--- ") | l.startswith("+++ "))
    note = F.col("_body") & F.col("_cuts")
    rows = d.where(F.when(F.col("_body"), ~F.col("_cuts") | F.col("_lead")).otherwise(~hdr_drop)).select(
        "output_id", "line_no", CHUNK_COL, F.when(note, F.lit("note")).otherwise("line").alias("kind"),
        F.when(note, gap_note).otherwise(l).alias("line"), F.when(note, F.col("_glen")).otherwise(0).cast("long").alias("n_omitted"))
    rows = segmented_scan(rows, ["output_id"], "line_no", dealt=True, running_sum={"_cum": F.lit(1)})
    rows = rows.join(files, "output_id", "left")
    lead_note = F.when(F.col("_f") > multifile, 1).otherwise(0)
    out = rows.select("output_id", (F.col("_cum") - 1 + lead_note).cast("long").alias("seq"), "kind",
                      F.col("line_no").cast("int").alias("src_line_no"), "line", "n_omitted")
    head, tail = FILES_NOTE.split("{n}")
    head = head.replace("{marker}", marker)
    notes = files.where(F.col("_f") > multifile).select(
        "output_id", F.lit(0).cast("long").alias("seq"), F.lit("note").alias("kind"),
        F.lit(None).cast("int").alias("src_line_no"),
        F.concat(F.lit(head), F.col("_f").cast("string"), F.lit(tail)).alias("line"),
        F.col("_f").cast("long").alias("n_omitted"))
    return out.unionByName(notes)
