"""Operator 3: line de-duplication by a log-template tree.

A line's path in the tree has a fixed depth: its token count, its leading tokens,
then its template.  Tokens that look like fields (with a digit, an address, a
link) become ``<*>``; and where the rest of the line is long enough, it is cut
into ``PARTS`` parts and the line joins ``PARTS`` templates, each with one part
generalised to ``<*>``.  So lines that differ in fields, or only inside one part,
meet in a template without being compared with each other, however many lines a
node of the tree has.

A template recurs when enough documents have it.  Every line whose template recurs is
dropped, but for the first document (least id) that has it: a group of copies
keeps its text once.

Templates are known by 64-bit hashes.  Counting them is one aggregation with
map-side sums; the recurring ones are joined back to the (template, line) pairs,
and the text is rebuilt from the lines that stay.  A template that a third of all
documents share is one row of the joined table.

Defined results: a null text stays null and has no lines; blank lines and lines
under ``LEAST_TOKENS`` tokens that are no fields stay; repeated rows (same id and text) are one
document; documents with a null id come after all others, by the hash of their text,
so null ids with different texts are different documents.  Extra columns are
carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

LEAST_TOKENS = 3            # fewer tokens, or fewer that are no field, recur by chance
LEAD = 2                    # leading tokens in the path
PARTS = 4
LONG_TOKENS = 8             # from here on a line has parts
DOCS_LONG, DOCS_SHORT = 2, 5          # documents that make a long, a short template recur

_FIELD = re.compile(rb"[0-9@]|://")
LAST = (1 << 63) - 1


def parts(n: int) -> list[tuple[int, int]]:
    """The token ranges that a line's templates generalise."""
    rest = n - LEAD
    return [(LEAD + rest * p // PARTS, LEAD + rest * (p + 1) // PARTS) for p in range(PARTS)]


def templates(line: bytes) -> list[int]:
    """Hashes of the line's templates (none for short lines)."""
    import xxhash
    tokens = line.split()
    n = len(tokens)
    if n < LEAST_TOKENS:
        return []
    if _FIELD.search(line):
        tokens = [b"<*>" if _FIELD.search(t) else t for t in tokens]
    if n < LONG_TOKENS:
        if n - tokens.count(b"<*>") < LEAST_TOKENS:
            return []
        return [xxhash.xxh3_64_intdigest(b"%d\n" % n + b"\n".join(tokens)) - (1 << 63)]
    cut = parts(n)
    texts = [b"\n".join(tokens[a:b]) for a, b in cut]
    lead = b"\n".join(tokens[:LEAD])
    out = []
    for p, (a, b) in enumerate(cut):
        if n - (b - a) - tokens.count(b"<*>") + tokens[a:b].count(b"<*>") >= LEAST_TOKENS:
            out.append(xxhash.xxh3_64_intdigest(b"\n".join([b"%d %d" % (n, p), lead, *texts[:p], b"<*>", *texts[p + 1:]])) - (1 << 63))
    return out


def _line_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keys, lines, longs, worded = [], [], [], []
            for text in batch.column("text").to_pylist():
                k, where, is_long, n = [], [], [], 0
                for i, line in enumerate((text or b"").split(b"\n")):
                    n += bool(line.strip())
                    found = templates(line)
                    k += found
                    where += [i] * len(found)
                    is_long += [len(line.split()) >= LONG_TOKENS] * len(found)
                keys.append(k)
                lines.append(where)
                longs.append(is_long)
                worded.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("h"), pa.array(worded, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(lines, pa.list_(pa.int32())), pa.array(longs, pa.list_(pa.bool_()))],
                names=["o", "h", "n_lines", "keys", "lines", "longs"])


def drop_recurring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None,
                   n_dropped: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with recurring lines cut out of the text; optionally with columns
    for the lines with a word and for the dropped ones (named by the caller)."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    kind = docs.schema[id_col].dataType.simpleString()
    order = F.col(id_col).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(id_col)
    o, h, lines, drop, total = fresh(docs, "_o", "_h", "_lines", "_drop", "_total")
    d = docs.withColumn(o, F.coalesce(F.when(F.col(id_col).isNotNull(), order), F.lit(LAST))) \
        .withColumn(h, F.xxhash64(text_col))
    found = scratch.keep(
        d.select(F.col(o).alias("o"), F.col(h).alias("h"), F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(_line_templates, "o long, h long, n_lines long, keys array<long>, lines array<int>, longs array<boolean>"), "templates")
    # a document counts once for a template, repeated rows once altogether
    # documents are told apart by id (o), those without one by text (t)
    found = found.withColumn("t", F.when(F.col("o") == LAST, F.col("h")).otherwise(F.lit(0).cast("long")))
    pairs = found.select("o", "h", "t", F.explode(F.arrays_zip("keys", "lines", "longs")).alias("z")) \
        .select("o", "h", "t", F.col("z.keys").alias("key"), F.col("z.lines").alias("line"), F.col("z.longs").alias("long"))
    once = found.select("o", "t", F.explode(F.array_distinct(F.arrays_zip("keys", "longs"))).alias("z")) \
        .select("o", "t", F.col("z.keys").alias("key"), F.col("z.longs").alias("long")).distinct()
    recurring = scratch.keep(
        once.groupBy("key", "long").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"), F.min("t").alias("first_t"))
        .where(F.expr(f"n >= CASE WHEN long THEN {DOCS_LONG} ELSE {DOCS_SHORT} END")).select("key", "first", "first_t"), "recurring")
    # only where no document of the template has an id does the text decide which is first
    gone = pairs.select("key", "o", "h", "t", "line").join(recurring, "key").where(f"o <> first OR (first = {LAST} AND t <> first_t)") \
        .groupBy("o", "h").agg(F.collect_set("line").alias("drop"))
    per_doc = found.select("o", "h", "n_lines").distinct().join(gone, ["o", "h"], "left") \
        .select(F.col("o").alias("_do"), F.col("h").alias("_dh"), F.col("n_lines").alias(total), F.col("drop").alias(drop))
    per_doc = scratch.keep(per_doc, "drops")
    d = d.join(per_doc, (d[o] == per_doc["_do"]) & (d[h] == per_doc["_dh"]), "left").drop("_do", "_dh")
    d = d.withColumn(lines, F.when(F.size(drop) > 0, F.split(F.col(text_col), "\n")))
    left = F.expr(f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{drop}`), i -> `{lines}`[i]), '\\n')")
    out = [F.when(F.col(lines).isNotNull(), left).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c)
           for c in docs.columns]
    if n_lines:
        out.append(F.coalesce(F.col(total), F.lit(0)).cast("long").alias(n_lines))
    if n_dropped:
        out.append(F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long").alias(n_dropped))
    return d.select(*out)


def oracle() -> str:
    """DuckDB SQL of the digest query."""
    bounds = "[" + ", ".join(f"[{LEAD} + (n - {LEAD}) * {p} // {PARTS}, {LEAD} + (n - {LEAD}) * {p + 1} // {PARTS}]" for p in range(PARTS)) + "]"
    return f"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT *, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
                  lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w FROM l),
n AS (SELECT *, len(w) AS n FROM t),
b AS (SELECT *, unnest({bounds}) AS cut, unnest(range({PARTS})) AS p FROM n WHERE n >= {LONG_TOKENS}),
k AS (SELECT doc_id, i, n, true AS long, p || ' ' || n || ' ' || array_to_string(w[:cut[1]], ' ') || ' <*> ' || array_to_string(w[cut[2] + 1:], ' ') AS key FROM b
      WHERE len(list_filter(w[:cut[1]] || w[cut[2] + 1:], lambda x: x <> '<*>')) >= {LEAST_TOKENS}
      UNION ALL
      SELECT doc_id, i, n, false, n || ' ' || array_to_string(w, ' ') FROM n
      WHERE len(list_filter(w, lambda x: x <> '<*>')) >= {LEAST_TOKENS} AND n < {LONG_TOKENS}),
r AS (SELECT key, long, min(doc_id) AS first FROM k GROUP BY key, long
      HAVING count(DISTINCT doc_id) >= CASE WHEN long THEN {DOCS_LONG} ELSE {DOCS_SHORT} END),
g AS (SELECT DISTINCT k.doc_id, k.i FROM k JOIN r ON k.key = r.key AND k.long = r.long WHERE k.doc_id <> r.first),
x AS (SELECT n.doc_id, count(*) FILTER (n.n > 0) AS n_lines, count(g.i) AS n_dropped,
             coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text
      FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_dropped, 0) AS n_dropped, md5(x.text) AS text_md5
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id"""
