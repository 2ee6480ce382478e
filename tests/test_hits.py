"""Fixture cases and randomized equality against a model of the keep rules."""

import random
import re

from pyspark.sql import Row

from linesift.operators.hits import compact_search_hits

HIT = re.compile(r"^(.+?):(\d+):(.*)", re.S)
CTX = re.compile(r"^(.+?):(\d+)-(.*)", re.S)


def _parse(line):
    """(kind, file, number, text) of one line."""
    raw = line.rstrip("\n\r")
    if raw == "--":
        return "S", None, None, None
    for kind, pattern in (("H", HIT), ("C", CTX)):
        m = pattern.match(raw)
        if m:
            return kind, m.group(1), int(m.group(2)), m.group(3).strip(" \t\n\r\x0b\f")
    return "O", None, None, None


def model(lines, cap=5, context=2, marker="# linesift:"):
    """The three keep rules, stated on the labelled list and looked up by plain search.

    A hit is kept if it is the first of its text in its file and among the file's
    first ``cap`` texts; other hits are dropped.  Events are K(ept), D(ropped),
    S(eparator) and O(ther); context lines are none.
    """
    rows = [_parse(x) for x in lines]
    texts = {}                              # file -> its different texts in order
    for kind, file, _, text in rows:
        if kind == "H" and text not in texts.setdefault(file, []):
            texts[file].append(text)

    def label(i):
        kind, file, _, text = rows[i]
        if kind != "H":
            return kind
        first = all(rows[j][:2] != ("H", file) or rows[j][3] != text for j in range(i))
        return "K" if first and texts[file].index(text) < cap else "D"

    labels = [label(i) for i in range(len(rows))]
    event = [i for i, x in enumerate(labels) if x != "C"]

    def kept(i):
        if labels[i] in "KO":
            return True
        if labels[i] == "D":
            return False
        after = [j for j in event if j > i]
        if labels[i] == "S":
            return next((labels[j] for j in after if labels[j] != "D"), "") == "K"
        end = after[0] if after else len(rows)
        before = [j for j in event if j < i]
        if end - i > context:               # only context lines stand between this one and the event
            return False
        follows = labels[end] if after else "end"
        return follows == "K" or (follows in ("S", "O", "end") and not (before and labels[before[-1]] == "D"))

    out = [x for i, x in enumerate(lines) if kept(i)]
    for file, order in texts.items():
        mine = [i for i, r in enumerate(rows) if r[0] == "H" and r[1] == file]
        n_kept = sum(labels[i] == "K" for i in mine)
        over = [rows[i][2] for i in mine if order.index(rows[i][3]) >= cap]
        repeats = len(mine) - n_kept - len(over)
        if n_kept == len(mine):
            continue
        why = ([f"{repeats} duplicate"] if repeats else []) + (
            [f"{len(over)} over cap at lines " + ", ".join(map(str, over[:10])) + (f" (+{len(over) - 10} more)" if len(over) > 10 else "")]
            if over else [])
        out.append(f"{marker} {file} kept {n_kept}/{len(mine)} matches; {len(mine) - n_kept} more matches omitted ({', '.join(why)})\n")
    return out


def run(spark, outputs, **kw):
    rows = [Row(output_id=k, line_no=i, line=l) for k, ls in outputs.items() for i, l in enumerate(ls)]
    df = spark.createDataFrame(rows, "output_id long, line_no int, line string")
    got = {}
    for r in compact_search_hits(df, **kw).orderBy("output_id", "seq").collect():
        got.setdefault(r.output_id, []).append((r.seq, r.line))
    for v in got.values():
        assert [s for s, _ in v] == list(range(len(v)))
    return {k: [l for _, l in v] for k, v in got.items()}


def test_fixture_cases(spark):
    over = [f"file.py:{i}:match {i}\n" for i in range(7)]
    dup = ["file.py:1:same\n", "file.py:2:same\n", "file.py:3:same\n"]
    two = ["a.py:1:x\n", "b.py:1:x\n"]
    noprefix = ["152:    def run(self):\n"]
    hint = [f"f.py:{i}:m{i}\n" for i in range(20)]
    got = run(spark, {1: over, 2: dup, 3: two, 4: noprefix, 5: hint})
    assert got[1][:5] == over[:5]
    assert got[1][5] == ("# linesift: file.py kept 5/7 matches; 2 more matches omitted "
                         "(2 over cap at lines 5, 6)\n")
    assert got[2] == [dup[0], "# linesift: file.py kept 1/3 matches; 2 more matches omitted (2 duplicate)\n"]
    assert got[3] == two
    assert got[4] == noprefix
    assert got[5][-1].endswith("over cap at lines 5, 6, 7, 8, 9, 10, 11, 12, 13, 14 (+5 more))\n")


def test_dropped_group_context(spark):
    lines = [f"f.py:{i}:hit {i}\n" for i in range(5)] + ["--\n", "f.py:9-ctx\n", "f.py:10:hit 6\n", "f.py:11-after\n"]
    assert run(spark, {1: lines})[1] == model(lines)


def _random_output(rnd):
    files = [f"src/m{j}.py" for j in range(rnd.randint(1, 3))]
    out = []
    for _ in range(rnd.randint(0, 40)):
        r = rnd.random()
        f = rnd.choice(files)
        n = rnd.randint(1, 300)
        if r < 0.45:
            out.append(f"{f}:{n}:{rnd.choice(['foo', 'bar', ' baz', 'qux ', 'x', 'y', 'z', 'w'])}\n")
        elif r < 0.75:
            out.append(f"{f}:{n}-ctx {rnd.randint(0, 9)}\n")
        elif r < 0.9:
            out.append("--\n")
        else:
            out.append(rnd.choice(["Binary file matches\n", "plain text\n"]))
    return out


def test_random_against_model(spark):
    rnd = random.Random(11)
    outputs = {k: _random_output(rnd) for k in range(150)}
    outputs = {k: v for k, v in outputs.items() if v}
    for cap, ctx, chunk in ((5, 2, 1 << 16), (2, 1, 3), (1, 0, 2)):
        got = run(spark, outputs, cap=cap, context=ctx, chunk_rows=chunk)
        for k, ls in outputs.items():
            assert got.get(k, []) == model(ls, cap, ctx), (cap, ctx, chunk, k)
