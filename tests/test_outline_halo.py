"""T14's look-ahead over chunk borders: any chunk length gives the hints of one chunk."""

import random

from linesift.operators.document import is_entry, outline_hints
from linesift.functions.text import ws_strip
from pyspark.sql import functions as F


def _files(spark):
    rnd = random.Random(14)
    pool = ["def f(a):\n", "    def g(\n", "        x):\n", "class C:\n", "    \"\"\"Doc.\"\"\"\n", "    '''\n", "\n", "    # note\n",
            "    return 1\n", "x = 2\n", "    text here\n", "async def h():\n", "    @wrap\n"]
    rows = [(o, n, rnd.choice(pool)) for o in (1, 2, None) for n in range(rnd.randrange(60, 140))]
    rows += [(3, 0, "def last():\n"), (4, 0, "def gap():\n"), *((4, n, "\n") for n in range(1, 11)), (4, 11, "    'far'\n")]
    return spark.createDataFrame(rows, "output_id int, line_no int, line string")


def test_hints_do_not_depend_on_chunks(spark):
    lines = _files(spark).cache()
    entries = lines.where(is_entry(ws_strip(F.col("line"))))
    n = entries.count()
    whole = {(r.output_id, r.line_no): r.hint for r in outline_hints(lines, entries).collect()}
    assert len(whole) == n and whole[(4, 0)] == "doc: far" and whole[(3, 0)] is None
    assert sum(h is not None for h in whole.values()) > n / 3          # the fixture has entries with a hint and without
    for chunk in (1, 7, 23, 40):
        got = outline_hints(lines, entries, chunk_rows=chunk).collect()
        assert {(r.output_id, r.line_no): r.hint for r in got} == whole and len(got) == n


def test_look_ahead_joins_no_lines(spark):
    lines = _files(spark)
    hints = outline_hints(lines, lines.where(is_entry(ws_strip(F.col("line")))))
    plan = hints._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1                 # entries with what was collected for them
