"""version-control lines are dealt to their chunks once."""

import glob
import random

from linesift.operators import scan
from linesift.operators.dispatch import compact
from linesift.operators.vcs import classify_vcs, compact_diff, deal_by_shape
from linesift.session import ensure_checkpoint_dir


def _cuts(spark):
    return len(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/linesift-cut-*"))


def _diffs():
    """Diffs with long and short gaps, lines of all kinds, dropped lines inside hunks."""
    rnd, out = random.Random(5), {}
    for k in range(6):
        text = []
        for f in range(k + 1):
            text += [f"diff --git a/f{f} b/f{f}", "index 12..34 100644", f"--- a/f{f}", f"+++ b/f{f}"]
            for h in range(rnd.randint(0, 2)):
                text.append(f"@@ -1,9 +{rnd.randint(1, 90)},9 @@" if rnd.random() < 0.8 else "@@ odd")
                for _ in range(rnd.randint(0, 45)):
                    text.append(rnd.choices([" same", "+new", "-old", "\\ No newline", "bare", "index 1..2"], [60, 2, 2, 1, 1, 2])[0])
        out[f"d{k}"] = text
    return out


def _frame(spark, texts):
    rows = [(o, i, l + "\n") for o, t in texts.items() for i, l in enumerate(t)]
    return spark.createDataFrame(rows, "output_id string, line_no int, line string")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diffs_are_dealt_once_and_cut_nowhere(spark):
    lines = _frame(spark, _diffs())
    cuts, kept = _cuts(spark), len(scan._UNSCOPED)
    whole = _rows(compact_diff(lines))
    assert _cuts(spark) == cuts and len(scan._UNSCOPED) - kept <= 2
    assert any(r[2] == "note" for r in whole)
    assert _rows(compact_diff(lines, chunk_rows=4)) == whole


def test_dispatch_gives_vcs_lines_their_shape_without_a_join(spark):
    texts = _diffs() | {"log": [l for k in range(30) for l in (f"commit {k:040x}", "", "    text")], "other": ["On branch main"] * 3}
    lines = _frame(spark, texts)
    want = {r.output_id: r.shape for r in classify_vcs(lines).collect()}
    dealt = deal_by_shape(lines, chunk_rows=3)
    assert {(r.output_id, r.shape) for r in dealt.collect()} == set(want.items())
    kept = len(scan._UNSCOPED)
    out = compact(lines.selectExpr("*", "'git' command"))
    assert len(scan._UNSCOPED) - kept <= 2
    got = _rows(out)
    assert [r for r in got if r[0].startswith("d")] == _rows(compact_diff(_frame(spark, _diffs())))
    assert sum(r[0] == "log" for r in got) == 60 and sum(r[0] == "other" for r in got) == 3
