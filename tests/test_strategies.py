"""Listing, log, diff, file-view and dispatch strategies: fixture cases."""

from pyspark.sql import Row

from linesift.operators.dispatch import compact, line_metrics
from linesift.operators.document import document_view, outline
from linesift.operators.listing import compact_listing
from linesift.operators.vcs import cap_log_entries, classify_vcs, compact_diff


def lines_df(spark, outputs, extra=None):
    rows = []
    for k, ls in outputs.items():
        for i, l in enumerate(ls):
            r = dict(output_id=str(k), line_no=i, line=l)
            r.update((extra or {}).get(k, {}))
            rows.append(Row(**r))
    return spark.createDataFrame(rows)


def collect(df):
    got = {}
    for r in df.orderBy("output_id", "seq").collect():
        got.setdefault(r.output_id, []).append((r.seq, r.line))
    for v in got.values():
        assert [s for s, _ in v] == list(range(len(v))), v
    return {k: [l for _, l in v] for k, v in got.items()}


def test_listing(spark):
    big = ([f"src/m{i}.py\n" for i in range(40)] + [f"docs/d{i}.md\n" for i in range(12)]
           + [f"bin/tool{i}\n" for i in range(8)])
    many_groups = [f"f{i}.e{i}\n" for i in range(45)]
    got = collect(compact_listing(lines_df(spark, {
        "dup": ["a\n", "a\n", "b\n"], "big": big, "long": ["total 2\n", "-rw-r--r-- 1 u g 0 a\n"],
        "plain": ["x\n", "y\n"], "head": many_groups})))
    assert got["dup"] == ["a\n", "b\n"]
    assert got["long"] == ["total 2\n", "-rw-r--r-- 1 u g 0 a\n"]
    assert got["plain"] == ["x\n", "y\n"]
    b = got["big"]
    assert b[0] == "# linesift: kept 12/60 unique entries across 3 groups\n"
    assert b[1] == "# .py: 40 entries\n" and b[2:6] == big[:4] and b[6] == "# ... 36 more .py entries omitted\n"
    assert "# .md: 12 entries\n" in b and "# [no extension]: 8 entries\n" in b
    assert got["head"] == many_groups[:40]                      # grouped form not shorter: head, no note


def test_log_cap(spark):
    std = []
    for i in range(25):
        std += [f"commit {i:07x}abcdef\n", "Author: a\n", "\n", f"    msg {i}\n", "\n"]
    one = [f"{i:07x}abc message {i}\n" for i in range(30)]
    graph = []
    for i in range(25):
        graph += [f"* {i:07x}abc msg\n", "|\n"]
    got = collect(cap_log_entries(lines_df(spark, {"std": std, "one": one, "graph": graph})))
    assert len(got["std"]) == 100 and got["std"][-1] == "\n"
    assert got["one"] == one[:20]
    assert len(got["graph"]) == 40
    shapes = {r.output_id: r.shape for r in classify_vcs(lines_df(spark, {
        "d": ["diff --git a/x b/x\n"], "l": std[:5], "o": ["hello\n"]})).collect()}
    assert shapes == {"d": "diff", "l": "log", "o": "other"}


def _hunk(before, body_mid, after):
    return ([" ctx\n"] * before) + body_mid + ([" ctx\n"] * after)


def test_diff(spark):
    head = ["diff --git a/f b/f\n", "index 123..456 100644\n", "--- a/f\n", "+++ b/f\n", "@@ -1,26 +1,26 @@\n"]
    large = head + _hunk(12, ["-old\n", "+new\n"], 12)
    two = head + ["+a\n"] + [" s\n"] * 20 + ["+b\n"]
    lookalike = head + ["--- removed text\n", " x\n"]
    four = []
    for i in range(4):
        four += [f"diff --git a/f{i} b/f{i}\n", f"--- a/f{i}\n", f"+++ b/f{i}\n", "@@ -1 +1 @@\n", "-x\n", "+y\n"]
    got = collect(compact_diff(lines_df(spark, {"large": large, "two": two, "look": lookalike, "four": four})))
    g = got["large"]
    assert "index 123..456 100644\n" not in g
    assert g[4] == "... (9 lines omitted, lines 1-9)\n" and g[-1] == "... (9 lines omitted, lines 17-25)\n"
    assert sum(1 for l in got["two"] if l.startswith("... (")) == 1
    assert "--- removed text\n" in got["look"]
    f = got["four"]
    assert f[0] == "# linesift: 4 files changed — file headers compressed\n"
    assert not any(l.startswith("--- ") or l.startswith("+++ ") for l in f)


def test_document_view(spark):
    files = spark.createDataFrame([("py", "a.py", 4), ("sh", "a.sh", 2), ("lim", "b.md", 5)],
                                  "output_id string, filename string, total_lines long")
    got = collect(document_view(lines_df(spark, {
        "py": ["code here\n", "\n", "   \n", "# comment\n"], "sh": ["#!/bin/sh\n", "echo\n"],
        "lim": [f"l{i}\n" for i in range(5)]}), files, limit=3))
    assert got["py"] == ["code here\n"]
    assert got["sh"] == ["#!/bin/sh\n", "echo\n"]
    assert got["lim"][:3] == ["l0\n", "l1\n", "l2\n"]
    assert got["lim"][3] == "\n# linesift: b.md has 5 lines total — for more: tail -n +4 b.md | head -3\n"
    from linesift.operators.document import resume_points
    blanks = spark.createDataFrame([("g", "c.md", 6)], "output_id string, filename string, total_lines long")
    view = document_view(lines_df(spark, {"g": ["a\n", "\n", "b\n", "\n", "c\n", "d\n"]}), blanks, limit=3)
    assert collect(view)["g"][3].endswith("tail -n +4 c.md | head -3\n")          # reference's hint kept
    assert [r.resume_line_no for r in resume_points(view).collect()] == [6]           # line after "c"


def test_outline(spark):
    code = ["class Widget:\n", "    @classmethod\n", "    def build(cls):\n",
            '        """Build an instance of the widget."""\n', "        return cls()\n", "\n",
            "async def fetch_data(client, key):\n", "    # look in the cache\n", "    if key in client.cache:\n",
            "        return client.cache[key]\n", "def open_sig(a,\n", "        b):\n", "    return a\n"]
    files = spark.createDataFrame([("o", "w.py", len(code))], "output_id string, filename string, total_lines long")
    got = collect(outline(lines_df(spark, {"o": code}), files))["o"]
    assert got[0] == "# linesift: Python outline for w.py (13 lines)\n"
    assert got[1] == "  L1: class Widget:  # def build(cls):\n"
    assert got[2] == "  L2:     @classmethod\n"
    assert got[3] == "  L3:     def build(cls):  # doc: Build an instance of the widget.\n"
    assert got[4] == "  L7: async def fetch_data(client, key):  # if key in client.cache:\n"
    assert got[5] == "  L11: def open_sig(a,  # return a\n"
    assert got[-1] == "\n# To read a section: sed -n 'START,ENDp' w.py\n"


def test_dispatch_and_binary(spark):
    from linesift.operators.dispatch import outputs_to_lines
    outs = spark.createDataFrame([
        ("1", "/usr/bin/rg", ["x"], "a.py:1:hit\na.py:2:hit\n", False),
        ("2", "echo", [], "same\n" * 5, False),
        ("3", "echo", [], "same\n" * 5, True),
        ("4", "cat", ["x.md"], "one\n\ntwo\n", False),
        ("5", "tool", [], "\u0000\u0001binary\n", False),
        ("6", "tool", [], "café\nnaïve\n", False)],
        "output_id string, command string, args array<string>, stdout string, full boolean")
    lines = outputs_to_lines(outs)
    got = collect(compact(lines))
    assert got["1"][0] == "a.py:1:hit\n" and got["1"][1].startswith("# linesift: a.py kept 1/2")
    assert got["2"] == ["same\n", "# ... repeated 5 times\n"]
    assert got["3"] == ["same\n"] * 5
    assert got["4"] == ["one\n", "two\n"]
    assert len(got["5"]) == 1 and len(got["6"]) == 2
    flags = {r.output_id: r.binary for r in lines.select("output_id", "binary").distinct().collect()}
    assert flags["5"] and not flags["6"]
    m = {r.output_id: r for r in line_metrics(lines, compact(lines)).collect()}
    assert m["2"].compressed_lines == 2 and m["3"].compressed_lines is None and m["3"].full


def test_dispatcher_passes_thresholds(spark):
    """Every cap can be lifted or lowered by the dispatcher's caller."""
    rows = [("rg", i, f"f.py:{i}:hit {i}\n") for i in range(7)] + [("make", i, f"line {i}\n") for i in range(30)]
    lines = spark.createDataFrame([(c, i, t, c) for c, i, t in rows], "output_id string, line_no int, line string, command string")
    got = compact(lines, options={"search": {"cap": 10}, "generic": {"limit": 5}}).collect()
    assert sum(r.output_id == "rg" for r in got) == 7 and not any(r.kind == "note" and r.output_id == "rg" for r in got)
    assert sum(r.output_id == "make" for r in got) == 6


def test_cut_listing_counts_what_it_leaves_out(spark):
    from linesift.operators.listing import compact_listing
    lines = spark.createDataFrame([(1, i, f"name{i}.x{i}\n") for i in range(60)], "output_id long, line_no int, line string")
    got = compact_listing(lines).collect()
    assert len(got) == 40 and sum(r.n_omitted for r in got) == 20
