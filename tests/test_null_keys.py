"""Outputs and documents without an id, or sharing one."""

from linesift.operators.checklist import checklist_json, checklist_phases, checklist_status
from linesift.operators.dispatch import compact, line_metrics
from linesift.operators.document import document_view, outline
from linesift.operators.hits import classify_hits, compact_search_hits, hit_status, search_hit_summary
from linesift.operators.listing import compact_listing
from linesift.operators.runs import collapse_runs
from linesift.operators.vcs import cap_log_entries, compact_diff

LINES = "output_id string, line_no int, line string, command string, args array<string>"


def _lines(command, texts, args=None):
    return [(i, k, t + "\n", command, args) for i, lines in texts.items() for k, t in enumerate(lines)]


def test_no_output_is_lost_without_an_id(spark):
    """An output without an id comes out as the same output with one does, beside an
    output whose id is the text 'null'."""
    diff = ["diff --git a/x b/x", "index 1..2", "--- a/x", "+++ b/x", "@@ -1,30 +1,30 @@", *[f" l{k}" for k in range(30)], "+new"]
    code = [t for k in range(60) for t in (f"def f{k}(x):", f"    return {k}")]
    files = spark.createDataFrame([(i, "x.py", 120) for i in ("id", None, "null")], "output_id string, filename string, total_lines long")
    cases = [(compact_listing, [f"d/f{k}.py" for k in range(60)]), (cap_log_entries, [f"abc{k:04x} message {k}" for k in range(30)]),
             (compact_diff, diff), (compact_search_hits, [f"a.py:{k}:hit {k % 8}" for k in range(20)]), (collapse_runs, ["same"] * 9),
             (lambda d: document_view(d, files), code), (lambda d: outline(d, files), code)]
    for operator, text in cases:
        lines = spark.createDataFrame(_lines("c", {"id": text, None: text, "null": text[:2]}), LINES).select("output_id", "line_no", "line")
        got = {}
        for r in operator(lines).collect():
            got.setdefault(r.output_id, []).append((r.seq, r.kind, r.src_line_no, r.line, r.n_omitted))
        assert set(got) == {"id", None, "null"} and sorted(got["id"], key=str) == sorted(got[None], key=str), text[:2]


def test_strategies_of_users_see_plain_keys(spark):
    lines = spark.createDataFrame(_lines("mine", {None: ["a", "b"], "x": ["c"]}), LINES)
    seen = []

    def mine(part):
        seen.append(part.schema["output_id"].dataType.simpleString())
        return part.selectExpr("output_id", "CAST(line_no AS LONG) AS seq", "'line' AS kind", "line_no AS src_line_no", "line", "0L AS n_omitted")

    out = compact(lines, {"mine": mine})
    assert seen == ["string"] and sorted((r.output_id or "", r.line) for r in out.collect()) == [("", "a\n"), ("", "b\n"), ("x", "c\n")]
    facts = {r.output_id: (r.line_count, r.lines_out) for r in line_metrics(lines, out).collect()}
    assert facts == {None: (2, 2), "x": (1, 1)}


def test_hits_and_listings_without_an_id(spark):
    lines = spark.createDataFrame(_lines("rg", {None: ["a:1:x", "a:2:x", "a:3:y"], "o": ["a:1:x"]}), LINES)
    status = hit_status(classify_hits(lines))
    assert sorted((r.output_id or "", r.line_no, r.status) for r in status.collect()) == \
        [("", 0, "kept"), ("", 1, "duplicate"), ("", 2, "kept"), ("o", 0, "kept")]
    assert {r.output_id: (r.kept, r.total) for r in search_hit_summary(status).collect()} == {None: (2, 3), "o": (1, 1)}
    ls = spark.createDataFrame(_lines("ls", {None: ["b", "a", "b"]}), LINES)
    assert [(r.output_id, r.line) for r in compact_listing(ls).orderBy("seq").collect()] == [(None, "b\n"), (None, "a\n")]


def test_documents_without_or_sharing_an_id(spark):
    one, two = "## Phase 1\n- [ ] first\n", "## Phase A\n- [x] done\n## Phase B\n- [ ] open\n"
    rows = [(1, one), (1, two), (None, one), (None, one), (2, None), (3, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.phase_count, r.all_tasks_done, r.next_task_title) for r in checklist_status(docs).collect()), key=str)
    assert got == sorted([(1, 1, False, "first"), (1, 2, False, "open"), (0, 1, False, "first"), (0, 1, False, "first"), (2, 0, True, None),
                          (3, 2, False, "open")], key=str)
    phases = sorted((r.doc_id or 0, r.phase_index, r.title, r.total_tasks) for r in checklist_phases(docs).collect())
    assert phases == [(0, 1, "Phase 1", 1), (1, 1, "Phase 1", 1), (1, 1, "Phase A", 1), (1, 2, "Phase B", 1), (3, 1, "Phase A", 1), (3, 2, "Phase B", 1)]
    assert checklist_json(docs).count() == len(rows)
