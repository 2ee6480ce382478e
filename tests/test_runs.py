"""Golden cases and randomized equality against a small sequential model."""

import random

from pyspark.sql import Row

from linesift.operators.runs import collapse_runs


def model(lines, threshold=3, limit=200):
    """Sequential statement of the semantics, for comparison only."""
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j] == lines[i]:
            j += 1
        if j - i > threshold:
            out += [lines[i], f"# ... repeated {j - i} times\n"]
        else:
            out += lines[i:j]
        i = j
    if limit is not None and len(out) > limit:
        out = out[:limit] + [f"# ... {len(out) - limit} more lines truncated\n"]
    return out


def run(spark, docs, **kw):
    rows = [Row(output_id=k, line_no=i, line=l) for k, ls in docs.items() for i, l in enumerate(ls)]
    df = spark.createDataFrame(rows, "output_id long, line_no int, line string")
    got = {}
    for r in collapse_runs(df, **kw).orderBy("output_id", "seq").collect():
        got.setdefault(r.output_id, []).append((r.seq, r.line))
    for k, v in got.items():
        assert [s for s, _ in v] == list(range(len(v))), "seq must be dense"
    return {k: [l for _, l in v] for k, v in got.items()}


def test_golden(spark):
    docs = {1: ["same line\n"] * 5, 2: ["line\n"] * 3, 3: [f"l{i}\n" for i in range(250)]}
    got = run(spark, docs)
    assert got[1] == ["same line\n", "# ... repeated 5 times\n"]
    assert got[2] == ["line\n"] * 3
    assert len(got[3]) == 201 and got[3][-1] == "# ... 50 more lines truncated\n"


def test_custom_thresholds(spark):
    got = run(spark, {1: ["same\n", "same\n", "tail 1\n", "tail 2\n"]}, threshold=1, limit=2)
    assert got[1] == ["same\n", "# ... repeated 2 times\n", "# ... 2 more lines truncated\n"]


def test_terminator_counts(spark):
    got = run(spark, {1: ["x\n", "x\n", "x\n", "x\n", "x"]})
    assert got[1] == ["x\n", "# ... repeated 4 times\n", "x"]


def test_random_small_chunks(spark):
    rnd = random.Random(7)
    docs = {}
    for k in range(120):
        n = rnd.randint(0, 60)
        docs[k] = [rnd.choice(["a\n", "b\n", "c\n"]) if rnd.random() < 0.7 else f"u{rnd.randint(0, 3)}\n"
                   for _ in range(n)]
        if rnd.random() < 0.2:
            docs[k] += ["z\n"] * rnd.randint(4, 30)
    docs = {k: v for k, v in docs.items() if v}
    for chunk in (1, 2, 3, 5, 64):
        for thr, lim in ((3, 200), (3, 10), (1, 7), (2, None)):
            got = run(spark, docs, threshold=thr, limit=lim, chunk_rows=chunk)
            for k, ls in docs.items():
                assert got.get(k, []) == model(ls, thr, lim), (chunk, thr, lim, k)
