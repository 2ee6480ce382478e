"""Directory-listing compaction (T7 parse, T8 dedup, T9 grouped sampling, E9).

Per output: blank lines and ``...:`` section headers are skipped; a ``total``
line or a long-format line passes the whole listing through.  Entries are
de-duplicated in first-seen order.  Up to ``max_entries`` unique entries are
returned as they are (verbatim when nothing was dropped); above that, entries
are grouped by extension label, groups ordered by (size desc, label), and up to
``per_group`` entries per group are taken round-robin up to ``max_entries`` in
total; the grouped form is used only when shorter than the unique list, else
the first ``max_entries`` unique entries are returned without a note.

Plan: dedup and group sizes are hash aggregates; the per-group sample uses
``row_number() <= per_group`` (planned as a WindowGroupLimit before the
shuffle, so a huge group costs ``per_group`` rows per task); groups beyond the
``max_entries`` largest can have no sample and end at the same kind of limit, so all
later windows run over at most ``per_group * max_entries`` rows per output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import eol_strip, ws_strip
from .compare import DEFAULT_MARKER
from .scan import keeps_null_keys, materialize

# Fixed values that must equal the reference's for equal results.
LISTING_MAX_ENTRIES = 40
GROUP_SAMPLE_CAP = 4
LONG_FORMAT_RE = "^(?:[bcdlps-][rwxStTs-]{9}|[bcdlps-][rwxStTs-]{10}|\\S+[+@]?)\\s+\\d+\\s+"


def group_label(entry: Column) -> Column:
    """E9: '[dir]' for a trailing '/', '[no extension]' when the base name has no
    dot or ends with one, else the lower-cased last suffix ('.gitignore' too)."""
    base = F.substring_index(F.regexp_replace(entry, "/+$", ""), "/", -1)
    return (F.when(entry.endswith("/"), F.lit("[dir]"))
            .when((F.instr(base, ".") == 0) | base.endswith("."), F.lit("[no extension]"))
            .otherwise(F.lower(F.concat(F.lit("."), F.substring_index(base, ".", -1)))))


@keeps_null_keys("lines")
def parse_listing(lines: DataFrame, key: str = "output_id") -> DataFrame:
    """Per line ``entry`` (NULL when skipped) and the per-output
    ``passthrough`` flag (any ``total`` or long-format line)."""
    raw = eol_strip(F.col("line"))
    stripped = ws_strip(raw)
    nonblank = stripped != ""
    passthrough = nonblank & (stripped.startswith("total ") | stripped.rlike(LONG_FORMAT_RE))
    d = lines.select(F.col(key).alias("output_id"), "line_no", "line",
                     F.when(nonblank & ~stripped.endswith(":"), stripped).alias("entry"),
                     passthrough.alias("_pt"))
    flags = d.groupBy("output_id").agg(F.max("_pt").alias("passthrough"), F.count(F.lit(1)).alias("n_lines"))
    return d.drop("_pt").join(flags, "output_id")


def dedup_listing(parsed: DataFrame) -> DataFrame:
    """Unique entries with their first line number."""
    return (parsed.where(F.col("entry").isNotNull())
            .groupBy("output_id", "entry").agg(F.min("line_no").alias("first_line")))


def group_sizes(unique: DataFrame) -> DataFrame:
    """Unique entries per extension label: ``output_id, label, size``."""
    return unique.groupBy("output_id", group_label(F.col("entry")).alias("label")).agg(F.count(F.lit(1)).alias("size"))


@keeps_null_keys("unique")
def sample_groups(unique: DataFrame, max_entries: int = LISTING_MAX_ENTRIES, per_group: int = GROUP_SAMPLE_CAP,
                  sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, samples).  groups: ``output_id, label, size, g`` (1-based order) of
    the ``max_entries`` largest groups, which alone can have a sample: entries are
    taken in rounds, one of each group in order.  samples: ``output_id, label, entry,
    n, p`` with ``p <= max_entries``."""
    sizes = group_sizes(unique) if sizes is None else sizes
    groups = sizes.withColumn("g", F.row_number().over(Window.partitionBy("output_id").orderBy(F.desc("size"), F.asc("label"))))
    groups = groups.where(F.col("g") <= max_entries)
    u = unique.withColumn("label", group_label(F.col("entry")))
    s = u.withColumn("n", F.row_number().over(Window.partitionBy("output_id", "label").orderBy("first_line")))
    s = s.where(F.col("n") <= per_group).join(groups.select("output_id", "label", "g"), ["output_id", "label"])
    s = s.withColumn("p", F.row_number().over(Window.partitionBy("output_id").orderBy("n", "g")))
    return groups, s.where(F.col("p") <= max_entries)


@keeps_null_keys("lines")
def compact_listing(lines: DataFrame, max_entries: int = LISTING_MAX_ENTRIES, per_group: int = GROUP_SAMPLE_CAP,
                    key: str = "output_id", marker: str = DEFAULT_MARKER) -> DataFrame:
    """T7 + T8 + T9 -> compacted rows (D3)."""
    parsed = materialize(parse_listing(lines, key))
    facts = parsed.select("output_id", "passthrough", "n_lines").distinct()
    unique = materialize(dedup_listing(parsed))
    counts = unique.groupBy("output_id").agg(F.count(F.lit(1)).alias("n_unique"))
    facts = facts.join(counts, "output_id", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))

    sizes = materialize(group_sizes(unique))
    groups, samples = map(materialize, sample_groups(unique, max_entries, per_group, sizes))
    taken = samples.groupBy("output_id", "label").agg(F.count(F.lit(1)).alias("taken"))
    g = groups.join(taken, ["output_id", "label"], "inner")           # groups with a sample are printed
    g = g.withColumns({"omitted": F.col("size") - F.col("taken"),
                       "_rows": 1 + F.col("taken") + F.when(F.col("size") > F.col("taken"), 1).otherwise(0)})
    wg = Window.partitionBy("output_id").orderBy("g")
    g = g.withColumn("_before", F.coalesce(F.sum("_rows").over(wg.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)) + 1)
    g = materialize(g)
    totals = g.groupBy("output_id").agg((F.sum("_rows") + 1).alias("_grouped_len"), F.sum("taken").alias("_kept"),
                                        F.count(F.lit(1)).alias("_printed"))
    n_groups = sizes.groupBy("output_id").agg(F.count(F.lit(1)).alias("_n_groups"))
    facts = facts.join(totals, "output_id", "left").join(n_groups, "output_id", "left")
    mode = (F.when(F.col("passthrough") | (F.col("n_unique") == F.col("n_lines")) & (F.col("n_unique") <= max_entries),
                   "verbatim")
            .when(F.col("n_unique") <= max_entries, "unique")
            .when(F.col("_grouped_len") >= F.col("n_unique"), "head")
            .otherwise("grouped"))
    facts = materialize(facts.withColumn("mode", mode))

    verbatim = parsed.join(facts.where(F.col("mode") == "verbatim").select("output_id"), "output_id").select(
        "output_id", F.col("line_no").cast("long").alias("seq"), F.lit("line").alias("kind"),
        F.col("line_no").alias("src_line_no"), "line", F.lit(0).cast("long").alias("n_omitted"))
    # first max_entries unique entries (in "unique" mode there are no more than that);
    # the rank filter right above the window is planned as a WindowGroupLimit
    ranked = unique.withColumn("_r", F.row_number().over(Window.partitionBy("output_id").orderBy("first_line")))
    ranked = ranked.where(F.col("_r") <= max_entries)
    # the last row of a cut list counts what it leaves out (no note is written)
    left_out = F.when((F.col("mode") == "head") & (F.col("_r") == max_entries), F.col("n_unique") - max_entries).otherwise(0)
    uniq_rows = ranked.join(facts.where(F.col("mode").isin("unique", "head")).select("output_id", "mode", "n_unique"), "output_id").select(
        "output_id", (F.col("_r") - 1).cast("long").alias("seq"), F.lit("line").alias("kind"),
        F.col("first_line").alias("src_line_no"), F.concat(F.col("entry"), F.lit("\n")).alias("line"),
        left_out.cast("long").alias("n_omitted"))

    gf = facts.where(F.col("mode") == "grouped")
    header = gf.select("output_id", F.lit(0).cast("long").alias("seq"), F.lit("note").alias("kind"),
                       F.lit(None).cast("int").alias("src_line_no"),
                       F.concat(F.lit(marker + " kept "), F.col("_kept").cast("string"), F.lit("/"),
                                F.col("n_unique").cast("string"), F.lit(" unique entries across "),
                                F.col("_n_groups").cast("string"), F.lit(" groups\n")).alias("line"),
                       (F.col("n_unique") - F.col("_kept")).cast("long").alias("n_omitted"))
    gg = g.join(gf.select("output_id"), "output_id")
    ghead = gg.select("output_id", F.col("_before").cast("long").alias("seq"), F.lit("note").alias("kind"),
                      F.lit(None).cast("int").alias("src_line_no"),
                      F.concat(F.lit("# "), F.col("label"), F.lit(": "), F.col("size").cast("string"),
                               F.lit(" entries\n")).alias("line"), F.lit(0).cast("long").alias("n_omitted"))
    gtail = gg.where(F.col("omitted") > 0).select(
        "output_id", (F.col("_before") + F.col("taken") + 1).cast("long").alias("seq"), F.lit("note").alias("kind"),
        F.lit(None).cast("int").alias("src_line_no"),
        F.concat(F.lit("# ... "), F.col("omitted").cast("string"), F.lit(" more "), F.col("label"),
                 F.lit(" entries omitted\n")).alias("line"), F.col("omitted").cast("long").alias("n_omitted"))
    srows = samples.join(gg.select("output_id", "label", "_before"), ["output_id", "label"]).select(
        "output_id", (F.col("_before") + F.col("n")).cast("long").alias("seq"), F.lit("line").alias("kind"),
        F.col("first_line").alias("src_line_no"), F.concat(F.col("entry"), F.lit("\n")).alias("line"),
        F.lit(0).cast("long").alias("n_omitted"))
    return verbatim.unionByName(uniq_rows).unionByName(header).unionByName(ghead).unionByName(gtail).unionByName(srows)
