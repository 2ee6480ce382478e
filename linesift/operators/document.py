"""File reads: document view (T12) and Python outline.

T12: blank lines (and ``#`` comment lines of ``.py`` files) are dropped, the
view stops at ``limit`` kept lines, and when the file had more than ``limit``
lines a two-line continuation note follows (QUIRK 6 kept: its resume point is
``kept + 1``).

T13: for ``.py`` files over the outline threshold, one row per ``class`` /
``def`` / ``async def`` line (textual test on the stripped line) with its
1-based number and indent, preceded by the decorators directly above it.
T14: a hint after each entry: the docstring's first text, or the first body
line, found within 12 lines (see ``outline_hints``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_hint, py_lstrip, py_strip, ws_lstrip, ws_rstrip, ws_strip
from .compare import DEFAULT_MARKER
from .scan import CHUNK_COL, DEFAULT_CHUNK_ROWS, keeps_null_keys, segmented_scan

# Fixed values that must equal the reference's for equal results.
CAT_LIMIT = 100
OUTLINE_THRESHOLD = 100
HINT_LOOKAHEAD = 12
HINT_CHARS = 80
DOCSTRING_RE = "^([rRuUbBfF]*)([\"']{3}|[\"'])"


def _decoded(line: Column) -> Column:
    """Decoded text of a line without its terminator."""
    return F.rtrim(line, F.lit("\n\r"))


def indent_of(line: Column) -> Column:
    """len(line) - len(line.lstrip()) on the raw line (terminator included)."""
    return F.length(line) - F.length(ws_lstrip(line))


def _d3(df: DataFrame, seq, kind, src, line, omitted) -> DataFrame:
    return df.select("output_id", seq.cast("long").alias("seq"), F.lit(kind).alias("kind") if isinstance(kind, str)
                     else kind.alias("kind"), src.cast("int").alias("src_line_no"), line.alias("line"),
                     omitted.cast("long").alias("n_omitted"))


@keeps_null_keys("lines", "files")
def document_view(lines: DataFrame, files: DataFrame, limit: int = CAT_LIMIT, key: str = "output_id",
                  marker: str = DEFAULT_MARKER) -> DataFrame:
    """T12.  ``files(output_id, filename, total_lines)``: filename may be NULL
    (no argument: no comment rule, no note)."""
    d = lines.select(F.col(key).alias("output_id"), "line_no", "line").join(files, "output_id", "left")
    stripped = ws_strip(F.col("line"))
    is_py = F.coalesce(F.col("filename").endswith(".py"), F.lit(False))
    keep = (stripped != "") & ~(is_py & stripped.startswith("#"))
    # the first ``limit`` kept lines: a limit per output before the shuffle, whatever follows
    w = Window.partitionBy("output_id")
    d = d.where(keep).withColumn("_k", F.row_number().over(w.orderBy("line_no"))).where(F.col("_k") <= limit)
    d = d.withColumn("_kept", F.count(F.lit(1)).over(w))
    kept = F.col("_kept")
    note_cond = F.coalesce(F.col("filename").isNotNull() & (F.col("total_lines") > 0) & (kept >= limit) & (F.col("total_lines") > limit), F.lit(False))
    note = F.concat(F.lit("\n" + marker + " "), F.col("filename"), F.lit(" has "), F.col("total_lines").cast("string"),
                    F.lit(" lines total — for more: tail -n +"), (kept + 1).cast("string"), F.lit(" "), F.col("filename"),
                    F.lit(f" | head -{limit}\n"))

    def row(seq, kind, src, line, omitted):
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), src.cast("int").alias("src_line_no"), line.alias("line"),
                        omitted.cast("long").alias("n_omitted"))

    text = row(F.col("_k") - 1, "line", F.col("line_no"), F.col("line"), F.lit(0))
    more = row(kept, "note", F.lit(None), note, F.col("total_lines") - kept)
    return d.select("output_id", F.explode(F.when((F.col("_k") == 1) & note_cond, F.array(text, more)).otherwise(F.array(text))).alias("r")) \
        .select("output_id", "r.*")


@keeps_null_keys("compacted")
def resume_points(compacted: DataFrame) -> DataFrame:
    """QUIRK 6, correct column: for every document view that was cut (it has a
    continuation note), ``resume_line_no`` = 1-based source line after the last
    kept line.  (The note's own ``tail -n +K`` keeps the reference's kept + 1,
    which is wrong once blank or comment lines were dropped.)"""
    cut_views = compacted.where(F.col("kind") == "note").select("output_id").distinct()
    last = compacted.where(F.col("kind") == "line").groupBy("output_id").agg(
        (F.max("src_line_no") + 2).cast("long").alias("resume_line_no"))
    return last.join(cut_views, "output_id")


def is_entry(stripped: Column) -> Column:
    return stripped.startswith("class ") | stripped.startswith("def ") | stripped.startswith("async def ")


@keeps_null_keys("lines", "entries")
def outline_hints(lines: DataFrame, entries: DataFrame, lookahead: int = HINT_LOOKAHEAD,
                  hint_chars: int = HINT_CHARS, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """T14 for the given entry rows ``(output_id, line_no, line)``.

    The following ``2 * lookahead - 1`` lines of every entry are found without a join:
    lines and entries are dealt by (output, chunk of positions), with the first lines
    of a chunk copied to the end of the one before.  There a line sees the entries
    just before it (a frame of that many positions) and goes to each.  They are
    collected per entry (bounded array) and scanned with ``aggregate``:
    skip blank lines; while the signature is open skip up to the line ending
    with ':'; stop at a line indented no deeper than the entry; skip comments
    and decorators; the first other line decides: a docstring opening gives
    ``doc: <text>`` (same line, or the next non-empty line within the
    lookahead, else ``docstring``), any other line is the hint itself.
    """
    span = 2 * lookahead - 1
    e = entries.select("output_id", F.col("line_no").alias("e_no"), F.col("line").alias("e_line"))
    at = F.col("line_no").cast("long")
    chunk = F.floor(at / chunk_rows)
    # a chunk's first lines stand in the chunks before that they may reach
    reach = F.sequence(F.greatest(F.lit(0), F.floor((at - span) / chunk_rows)), chunk)
    rows = lines.select("output_id", at.alias("line_no"), F.col("line").alias("_l"), F.explode(reach).alias(CHUNK_COL),
                        F.lit(None).cast("long").alias("_e"))
    rows = rows.unionByName(entries.select("output_id", at.alias("line_no"), F.lit(None).cast(lines.schema["line"].dataType).alias("_l"),
                                           chunk.alias(CHUNK_COL), at.alias("_e")))
    before = Window.partitionBy("output_id", CHUNK_COL).orderBy("line_no").rangeBetween(-span, -1)
    fl = rows.repartition("output_id", CHUNK_COL).withColumn("_near", F.collect_list("_e").over(before)) \
        .where(F.col("_e").isNull()).select("output_id", CHUNK_COL, "line_no", "_l", F.explode("_near").alias("e_no"))
    ctx = fl.groupBy("output_id", CHUNK_COL, "e_no").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("line_no") - F.col("e_no")).cast("int").alias("d"), F.col("_l").alias("l")))).alias("_f")).drop(CHUNK_COL)
    d = e.join(ctx, ["output_id", "e_no"], "left").withColumn("_f", F.coalesce("_f", F.array().cast(
        "array<struct<d:int,l:string>>")))
    base = indent_of(F.col("e_line"))
    in_sig0 = ~ws_rstrip(F.col("e_line")).endswith(":")
    items = F.transform("_f", lambda x: F.struct(
        x["d"].alias("d"), ws_strip(x["l"]).alias("s"), indent_of(x["l"]).alias("ind"),
        py_strip(_decoded(x["l"])).alias("t")))
    d = d.withColumns({"_base": base, "_items": items})

    # step 1: the deciding line (position d), 0 = none
    init = F.struct(in_sig0.alias("sig"), F.lit(0).alias("pos"), F.lit(False).alias("stop"))

    def step1(acc, x):
        done = acc["stop"] | (x["d"] > lookahead)
        return (F.when(done | (x["s"] == ""), acc)
                .when(acc["sig"], F.struct((~x["s"].endswith(":")).alias("sig"), F.lit(0).alias("pos"),
                                           F.lit(False).alias("stop")))
                .when(x["ind"] <= F.col("_base"), F.struct(acc["sig"].alias("sig"), F.lit(0).alias("pos"),
                                                           F.lit(True).alias("stop")))
                .when(x["s"].startswith("#") | x["s"].startswith("@"), acc)
                .otherwise(F.struct(acc["sig"].alias("sig"), x["d"].alias("pos"), F.lit(True).alias("stop"))))

    d = d.withColumn("_pos", F.aggregate("_items", init, step1)["pos"])
    first = F.try_element_at(F.filter("_items", lambda x: x["d"] == F.col("_pos")), F.lit(1))
    d = d.withColumn("_first", first)
    ftext = F.col("_first.t")
    prefix = F.regexp_extract(ftext, DOCSTRING_RE, 1)
    delim = F.regexp_extract(ftext, DOCSTRING_RE, 2)
    is_doc = ftext.rlike(DOCSTRING_RE)
    rem = F.substring(ftext, F.length(prefix) + F.length(delim) + 1, 1 << 30)
    end = F.instr(rem, delim)
    same_line = py_strip(F.when(end > 0, F.substring(rem, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rem))
    d = d.withColumns({"_delim": delim, "_same": F.when(rem != "", same_line).otherwise(F.lit(""))})

    # step 2: docstring text on a following line (positions pos+1 .. pos+lookahead-1)
    init2 = F.struct(F.lit(None).cast("string").alias("r"), F.lit(False).alias("stop"))

    def step2(acc, x):
        inside = (x["d"] > F.col("_pos")) & (x["d"] < F.col("_pos") + lookahead)
        txt = py_strip(F.when(F.instr(x["t"], F.col("_delim")) > 0,
                              F.substring(x["t"], 1, F.greatest(F.instr(x["t"], F.col("_delim")) - 1, F.lit(0))))
                       .otherwise(x["t"]))
        return (F.when(acc["stop"] | ~inside, acc)
                .when(txt != "", F.struct(txt.alias("r"), F.lit(True).alias("stop")))
                .when(x["ind"] <= F.col("_base"), F.struct(F.lit(None).cast("string").alias("r"),
                                                           F.lit(True).alias("stop")))
                .otherwise(acc))

    later = F.aggregate("_items", init2, step2)["r"]
    doc_hint = (F.when(F.col("_same") != "", F.concat(F.lit("doc: "), compact_hint(F.col("_same"), hint_chars)))
                .when(later.isNotNull(), F.concat(F.lit("doc: "), compact_hint(later, hint_chars)))
                .otherwise(F.lit("docstring")))
    hint = (F.when(F.col("_pos") == 0, F.lit(None).cast("string"))
            .when(is_doc, doc_hint)
            .otherwise(compact_hint(ftext, hint_chars)))
    return d.select("output_id", F.col("e_no").alias("line_no"), hint.alias("hint"))


@keeps_null_keys("lines", "files")
def outline(lines: DataFrame, files: DataFrame, key: str = "output_id", marker: str = DEFAULT_MARKER,
            chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """T13 + T14: outline rows (D3) for every output of ``lines``;
    ``files(output_id, filename, total_lines)`` names them."""
    d = lines.select(F.col(key).alias("output_id"), "line_no", "line")
    stripped = ws_strip(F.col("line"))
    dec = stripped.startswith("@")
    ent = ~dec & is_entry(stripped)
    # nearest following non-decorator line: entry (1) or anything else (2)
    code = F.when(~dec, F.col("line_no").cast("long") * 4 + F.when(ent, 1).otherwise(2))
    d = d.withColumns({"_dec": dec, "_ent": ent})
    d = segmented_scan(d, ["output_id"], "line_no", chunk_rows=chunk_rows, next_min={"_nxt": code}).drop(CHUNK_COL)
    owner = F.when(F.col("_dec") & ((F.col("_nxt") % 4) == 1), F.floor(F.col("_nxt") / 4))
    d = d.withColumn("_owner", F.when(F.col("_ent"), F.col("line_no")).otherwise(owner))
    rows = d.where(F.col("_owner").isNotNull())
    owners = rows.where(F.col("_ent")).select("output_id", F.col("line_no").alias("_owner"),
                                              indent_of(F.col("line")).alias("_oind"))
    rows = rows.join(owners, ["output_id", "_owner"])
    hints = outline_hints(d.select("output_id", "line_no", "line"), rows.where(F.col("_ent")).select(
        "output_id", "line_no", "line"))
    rows = rows.join(hints, ["output_id", "line_no"], "left")
    level = F.when(F.col("_oind") > 0, F.repeat(F.lit("    "), F.floor(F.col("_oind") / 4).cast("int"))).otherwise("")
    text = F.concat(F.lit("  L"), (F.col("line_no") + 1).cast("string"), F.lit(": "), level,
                    py_lstrip(_decoded(F.col("line"))),
                    F.when(F.col("hint").isNotNull(), F.concat(F.lit("  # "), F.col("hint"))).otherwise(F.lit("")),
                    F.lit("\n"))
    rows = segmented_scan(rows.select("output_id", "line_no", text.alias("text")), ["output_id"], "line_no",
                          chunk_rows=chunk_rows, running_sum={"_k": F.lit(1)}).drop(CHUNK_COL)
    body = _d3(rows, F.col("_k"), "line", F.col("line_no"), F.col("text"), F.lit(0))
    f = files.join(lines.select(F.col(key).alias("output_id")).distinct(), "output_id")
    counts = rows.groupBy("output_id").agg(F.count(F.lit(1)).alias("_n"))
    f = f.join(counts, "output_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    head = _d3(f, F.lit(0), "note", F.lit(None),
               F.concat(F.lit(marker + " Python outline for "), F.col("filename"), F.lit(" ("),
                        F.col("total_lines").cast("string"), F.lit(" lines)\n")), F.lit(0))
    foot = _d3(f, F.col("_n") + 1, "note", F.lit(None),
               F.concat(F.lit("\n# To read a section: sed -n 'START,ENDp' "), F.col("filename"), F.lit("\n")), F.lit(0))
    return head.unionByName(body).unionByName(foot)
