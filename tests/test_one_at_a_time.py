"""strategies and families are computed one after another, and what they leave on
disk goes before the next."""

import glob
from datetime import date

from linesift.operators import dispatch, scan
from linesift.operators.dispatch import compact, compacted_sizes, line_metrics
from linesift.operators.hits import compact_search_hits
from linesift.operators.scan import cut, cut_parts, segmented_scan
from linesift.operators.vcs import cap_log_entries, compact_diff
from linesift.plans.odd_keys import null_output_ids
from linesift.session import ensure_checkpoint_dir
from pyspark.sql import functions as F

LINES = "output_id string, line_no int, line string, command string, args array<string>, full boolean"


def _cuts(spark):
    return set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/linesift-cut-*"))


def _texts():
    log = [l for k in range(30) for l in (f"commit {k:040x}", "", f"    text {k}")]
    diff = ["diff --git a/x b/x", "index 1..2", "--- a/x", "+++ b/x", "@@ -1,40 +1,40 @@", *[f" l{k}" for k in range(40)], "+new"]
    late = ["text"] * 12 + log                                   # no log: its first entry is not among the first ten lines
    code = [t for k in range(60) for t in (f"def f{k}(x):", f"    return {k}")]
    return [("log", log, "git", None), ("diff", diff, "/usr/bin/git", None), ("late", late, "git", None), (None, log[:9], "git", None),
            ("rg", [f"a.py:{k}:hit {k % 8}" for k in range(30)], "rg", None), ("code", code, "cat", ["x.py"]), ("md", code, "read", ["x.md"]),
            (None, ["same"] * 9, None, None), ("mine", ["a"] * 3, "tools/mine", None), ("ls", [f"d/f{k}.py" for k in range(60)], "find", None)]


def _lines(spark, texts):
    return spark.createDataFrame([(i, k, t + "\n", c, a, False) for i, ts, c, a in texts for k, t in enumerate(ts)], LINES)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sizes_by_strategy_leave_nothing_else(spark):
    lines = cut(_lines(spark, _texts()))
    want = _rows(line_metrics(lines, compact(lines)))
    before, kept = _cuts(spark), len(scan._UNSCOPED)
    sizes = compact(lines, each=compacted_sizes)
    assert _rows(line_metrics(lines, sizes)) == want
    assert len(_cuts(spark) - before) == 1 and len(scan._UNSCOPED) - kept <= 1


def test_many_commands_and_many_diffs(spark, monkeypatch):
    lines = cut(_lines(spark, [t for t in _texts() if t[2] in ("git", "/usr/bin/git", None)]))
    want = _rows(compact(lines))
    monkeypatch.setattr(dispatch, "_FEW_COMMANDS", 0)
    monkeypatch.setattr(dispatch, "_FEW_OUTPUTS", 0)
    assert _rows(compact(lines)) == want


def test_shapes_within_the_scan_of_the_logs(spark):
    lines = cut(_lines(spark, [t for t in _texts() if t[0] in ("log", "late", "diff")]).select("output_id", "line_no", "line"))
    kept = len(scan._UNSCOPED)
    got = _rows(cap_log_entries(lines, leaf=True, shaped=False, chunk_rows=7))
    assert len(scan._UNSCOPED) == kept
    count = lambda o: sum(r[0] == o for r in got)
    assert (count("log"), count("late"), count("diff")) == (60, 102, 0)
    diff = lines.where("output_id = 'diff'")
    assert _rows(compact_diff(diff, leaf=True, chunk_rows=7)) == _rows(compact_diff(diff))


def test_a_leaf_is_scanned_as_other_frames_are(spark):
    d = cut(spark.range(200).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"), F.col("id").alias("p"),
                                    F.when(F.col("id") % 7 == 0, F.col("id")).alias("v")))
    how = dict(chunk_rows=16, running_sum={"s": F.lit(1)}, running_max={"m": F.col("v")}, next_min={"n": F.col("v")},
               total_sum={"t": F.lit(1)}, total_max={"x": F.col("v")}, previous={"b": "v"})
    kept = len(scan._UNSCOPED)
    leaf = segmented_scan(d, ["k"], "p", leaf=True, **how)
    assert len(scan._UNSCOPED) == kept
    assert _rows(leaf) == _rows(segmented_scan(d, ["k"], "p", **how))


def test_search_hits_with_equal_lines_and_positions(spark):
    lines = _lines(spark, [(o, [f"a.py:{k}:hit {k % 6}" for k in range(14)] + ["--", "a.py:20-near", "b:1:x"], "rg", None) for o in ("p", None, None)])
    got = [r for r in compact_search_hits(lines.select("output_id", "line_no", "line")).collect()]
    alone = [(r.seq, r.line) for r in got if r.output_id == "p"]
    assert alone[:2] == [(0, "a.py:0:hit 0\n"), (1, "a.py:1:hit 1\n")] and any("3 duplicate" in l or "over cap" in l for _, l in alone)
    assert {r.line for r in got if r.output_id is None and r.kind == "line"} == {l for _, l in alone if not l.startswith("#")}


def test_parts_free_their_tables(spark):
    before, kept = _cuts(spark), len(scan._UNSCOPED)
    whole = cut_parts(spark, [lambda k=k: scan.materialize(cut(spark.range(k).select("id", F.lit(k).alias("k")))) for k in (2, 3)])
    assert _rows(whole) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert len(_cuts(spark) - before) == 1 and len(scan._UNSCOPED) == kept


def _tables(spark, path):
    words = ["near the end", "x the y", "plain", "z"]
    docs = [(k, "\n".join(words[(k + j) % 4] for j in range(5 + 40 * (k % 3))), "en", ("web", "code")[k % 2]) for k in range(12)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        "pages": spark.createDataFrame([(k, f"http://h.org/en/p{k}.html", "<p>\n" * k + "x") for k in range(1, 50)], "page_id long, url string, html string"),
        "part": spark.createDataFrame([(k, f"red part {k}", "B1", "TIN", k % 12) for k in range(9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": spark.createDataFrame([(k, k % 4 + 1, date(2024, 1, 1), "O") for k in range(100)], "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string"),
        "lineitem": spark.createDataFrame([(k, 1, k, 1, 12.0) for k in range(100)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_families_without_an_id_keep_one_table(spark, tmp_path):
    before, kept = _cuts(spark), len(scan._UNSCOPED)
    out = null_output_ids(spark, _tables(spark, tmp_path))
    assert len(_cuts(spark) - before) == 1 and len(scan._UNSCOPED) == kept
    assert {(r.family, r.output_id is None) for r in out.collect()} >= {(f, True) for f in ("search", "log", "listing", "file")}
