"""Prefixes and top groups are limits before the shuffle, not scans."""

from pyspark.sql import functions as F

from linesift.operators.document import document_view
from linesift.operators.listing import compact_listing, dedup_listing, group_sizes, parse_listing, sample_groups
from linesift.operators.runs import truncate_tail

LINES = "output_id string, line_no int, line string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_truncation_is_a_filter_and_a_count(spark, tmp_path):
    rows = [(i, k, "line", k, f"{i}{k}\n", 0) for i, n in (("a", 3), ("b", 5), ("c", 9), (None, 7)) for k in range(n)]
    spark.createDataFrame(rows, "output_id string, seq long, kind string, src_line_no int, line string, n_omitted long").write.parquet(str(tmp_path / "c"))
    out = truncate_tail(spark.read.parquet(str(tmp_path / "c")), limit=5)
    got = {}
    for r in out.collect():
        got.setdefault(r.output_id, []).append((r.seq, r.kind, r.line, r.n_omitted))
    for i, n in (("a", 3), ("b", 5), ("c", 9), (None, 7)):
        want = [(k, "line", f"{i}{k}\n", 0) for k in range(min(n, 5))]
        if n > 5:
            want.append((5, "note", f"# ... {n - 5} more lines truncated\n", n - 5))
        assert sorted(got[i]) == want
    plan = _plan(out)
    assert "LessThan(seq,5)" in plan and "Window" not in plan and "InMemoryTableScan" not in plan


def test_view_is_a_limit_before_the_shuffle(spark):
    rows = [(i, k, "" if k % 3 == 0 else f"t{k}\n") for i in ("a", "b") for k in range(40)]
    files = spark.createDataFrame([("a", "x.md", 40), ("b", None, None)], "output_id string, filename string, total_lines long")
    out = document_view(spark.createDataFrame(rows, LINES), files, limit=6)
    kept = [(n, "line", k, f"t{k}\n") for n, k in enumerate([1, 2, 4, 5, 7, 8])]
    got = {i: sorted((r.seq, r.kind, r.src_line_no, r.line) for r in out.where(F.col("output_id") == i).collect()) for i in ("a", "b")}
    assert got["b"] == kept and got["a"][:6] == kept and got["a"][6][:3] == (6, "note", None) and "tail -n +7" in got["a"][6][3]
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "InMemoryTableScan" not in plan


def test_groups_beyond_the_largest_have_no_sample(spark):
    """200 labels: the 40 largest groups give the sample, all are counted."""
    names = [f"f{k}.e{e:03d}" for e in range(200) for k in range(1 + (e % 5))]
    lines = spark.createDataFrame([("o", k, f"{n}\n") for k, n in enumerate(names)], LINES)
    unique = dedup_listing(parse_listing(lines))
    groups, samples = sample_groups(unique)
    order = sorted(((1 + e % 5, f".e{e:03d}") for e in range(200)), key=lambda x: (-x[0], x[1]))
    assert [(r["size"], r.label) for r in groups.orderBy("g").collect()] == order[:40]
    assert [r.label for r in samples.orderBy("p").collect()] == [label for _, label in order[:40]]
    assert group_sizes(unique).count() == 200 and "WindowGroupLimit" in _plan(groups)
    head = compact_listing(lines).orderBy("seq").first().line
    assert head.endswith(f"kept 40/{len(names)} unique entries across 200 groups\n")


def test_a_report_frees_its_own_frames(spark):
    from linesift.operators.scan import materialize, scope
    mine = materialize(spark.range(10))
    with scope():
        lines = spark.createDataFrame([("o", k, f"f{k}.py\n") for k in range(50)], LINES)
        frame = materialize(spark.range(5))
        assert compact_listing(lines).count() == 7 and frame.is_cached
    assert not frame.is_cached and mine.is_cached
    mine.unpersist()
