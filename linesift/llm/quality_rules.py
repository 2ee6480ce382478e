"""Operator 5: quality rules by robust multivariate outliers, in DataFrame and
SQL functions only.

1. ``text_statistics`` computes each text's statistics inside its row.
2. ``vectors`` turns them into four numbers, each near normal for clean text and
   free of the length: log mean word length, log symbol rate, repeated line share
   and repeated word share, the rates shrunk for short texts.  They are rounded to
   1/1024, so that all sums below are sums of integers: every run and every
   partitioning gives the same estimates.
3. Per language and source a minimum-covariance-determinant estimate: from the
   medians and the statistics' natural scales, concentration steps take the
   ``share`` of the group's rows with the smallest Mahalanobis distance and
   estimate mean and covariance anew.  A step is one aggregation by (group, bin of
   log distance); the bin that completes the share closes the subset, so no group
   is sorted or gathered, and a group of a third of all rows is summed in parts
   like any other.
4. Rows whose distance from the final estimate passes ``cutoff`` are rejected.

Groups of fewer than ``least_rows`` usable rows are pooled by language, then
altogether; rows of a pool that is still smaller get no verdict and stay.

Defined results: a null text has no words, so the base rules reject it; null
languages and sources are groups of their own; repeated rows and ties are judged
alike; texts of any length are taken whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

SEP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHARE = 0.75
# Consistency of the covariance of the nearest 75 % of a normal sample in four dimensions:
# 0.75 / P(chi2(6) <= chi2(4) quantile 0.75).
CONSISTENCY = 1.485
CUTOFF = 23.51              # chi2(4) quantile 0.9999
STEPS = 4
LEAST_ROWS = 40
SCALES = (0.05, 0.25, 0.1, 0.05)          # least standard deviations; a statistic may be 0 in all clean rows
GRID = 1024
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# SQL that Spark and the DuckDB oracle share.
VECTOR = (
    "ln((word_chars + 250e0) / (n_words + 50e0))",
    "ln(1e0 + 10e0 * n_symbols / (n_words + 10e0))",
    "n_dup_lines / (n_lines + 4e0)",
    "n_repeat_words / (n_words + 50e0)",
)
BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
BIN = "CAST(floor(32 * ln(d2 + 1e-6)) AS INT)"
DIMS = range(len(VECTOR))
PAIRS = [(i, j) for i in DIMS for j in range(i + 1)]


def distance_steps() -> list[tuple[str, str]]:
    """(column, SQL): the squared Mahalanobis distance by forward substitution
    in the Cholesky factor l_ij of a row's group."""
    out = []
    for i in DIMS:
        minus = "".join(f" - l{i}{j} * y{j}" for j in range(i))
        out.append((f"y{i}", f"(x{i} / {GRID}e0 - m{i}{minus}) / l{i}{i}"))
    out.append(("d2", " + ".join(f"y{i} * y{i}" for i in DIMS)))
    return out


def cholesky_steps() -> list[tuple[str, str]]:
    """(column, SQL): the factor of the covariance c_ij, column by column."""
    out = []
    for j in DIMS:
        minus = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        out.append((f"l{j}{j}", f"sqrt(c{j}{j}{minus})"))
        for i in range(j + 1, len(VECTOR)):
            minus = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append((f"l{i}{j}", f"(c{i}{j}{minus}) / l{j}{j}"))
    return out


def moments(factor: float) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """SQL of the mean m_i and the covariance c_ij from integer sums s_i, p_ij over n rows."""
    mean = [(f"m{i}", f"s{i} / {GRID}e0 / n") for i in DIMS]
    cov = [(f"c{i}{j}", f"{factor:e} * (p{i}{j} / {GRID * GRID}e0 / n - m{i} * m{j})" + (f" + {SCALES[i] ** 2:e}" if i == j else ""))
           for i, j in PAIRS]
    return mean, cov


def _add(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df


def text_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the text's statistics (long): n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words.  Every step works on one row's arrays."""
    t = "_text"
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(t))
    d = d.select(
        *keep, F.expr(f"filter(split({t}, r'{SEP}'), w -> w <> '')").alias("_w"),
        F.expr(f"filter(split({t}, '\\n'), l -> trim(BOTH ' \\t\\u000B\\u000C\\r' FROM l) <> '')").alias("_l"),
        F.expr(f"char_length({t}) - char_length(translate({t}, '{SYMBOLS}', ''))").cast("long").alias("n_symbols"))
    d = d.select(
        *keep, "_w", "n_symbols", F.size("_w").cast("long").alias("n_words"),
        F.expr("char_length(array_join(_w, ''))").cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"))
    rest = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # 64-bit hashes of the 5-word windows: two windows of one text meet by chance once in 10^11 texts
    d = d.select(*rest, F.expr("""
        CASE WHEN size(_w) >= 5 THEN transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))
             ELSE cast(array() AS array<bigint>) END""").alias("_h"))
    d = d.select(*rest, F.expr("""
        CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h AS h, i AS p)))
             ELSE cast(array() AS array<struct<h: bigint, p: int>>) END""").alias("_s"))
    d = d.select(*rest, F.expr("""
        array_sort(transform(filter(transform(_s, (s, i) -> struct(s.p AS p,
            (i > 0 AND s.h = get(_s, i - 1).h) OR (i + 1 < size(_s) AND s.h = get(_s, i + 1).h) AS twice)), s -> s.twice), s -> s.p))""").alias("_p"))
    return d.select(*rest, F.expr(
        "aggregate(_p, struct(0L AS n, -5 AS e), (a, p) -> struct(a.n + least(5, p - a.e) AS n, p AS e), a -> a.n)").alias("n_repeat_words"))


def _group_keys(d: DataFrame, least_rows: int, scratch: Scratch) -> DataFrame:
    """Add ``g``: the row's (language, source), or the pool of its language's
    small groups, or the pool of what is left; null where that is too small."""
    narrow = d.where(f"NOT {BASE_FAILED}")
    keys = [F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("{}")]
    names = ["lang", "source"]
    sizes = narrow.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("g", F.when(F.col("n") >= least_rows, F.concat(F.lit("1"), keys[0])))
    by_lang = F.sum(F.when(F.col("g").isNull(), F.col("n"))).over(Window.partitionBy("lang"))
    sizes = sizes.withColumn("g", F.coalesce("g", F.when(by_lang >= least_rows, F.concat(F.lit("2"), keys[1]))))
    rest = scratch.keep(sizes, "sizes")
    left = rest.where("g IS NULL").agg(F.sum("n")).first()[0] or 0
    found = rest.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                        F.coalesce("g", F.lit("3") if left >= least_rows else F.lit(None).cast("string")).alias("g"))
    return d.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left") \
        .drop("_lang", "_source")


def _medians(rows: DataFrame) -> DataFrame:
    """(g, m_i): the lower median of every coordinate, by exact counts on the grid."""
    tall = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in DIMS])).alias("k", "x")) \
        .groupBy("g", "k", "x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g", "k")
    tall = tall.withColumn("upto", F.sum("c").over(w.orderBy("x"))).withColumn("all", F.sum("c").over(w))
    return tall.where("2 * upto >= all").groupBy("g", "k").agg(F.min("x").alias("x")) \
        .groupBy("g").agg(*[(F.max(F.when(F.col("k") == i, F.col("x"))) / float(GRID)).alias(f"m{i}") for i in DIMS])


def _concentrate(rows: DataFrame, params: DataFrame, share: float, factor: float) -> DataFrame:
    """One concentration step: (g, n, m_i, l_ij) from the nearest rows under ``params``."""
    d = _add(rows.join(params, "g"), distance_steps()).withColumn("bin", F.expr(BIN))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in DIMS] + \
        [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    bins = d.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.partitionBy("g")
    bins = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    near = bins.where(F.col("before") < share * F.col("all")).groupBy("g").agg(
        *[F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in DIMS), *(f"p{i}{j}" for i, j in PAIRS)]])
    mean, cov = moments(factor)
    near = _add(_add(near, mean), cov)
    return _add(near, cholesky_steps()).select("g", *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i, j in PAIRS])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          share: float = SHARE, cutoff: float = CUTOFF, steps: int = STEPS, least_rows: int = LEAST_ROWS,
          scratch: Scratch | None = None) -> DataFrame:
    """(id, statistics, base_failed, distance, kept, text_hash) per document;
    ``distance`` is the squared robust distance, null without a verdict."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                    F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    d = text_statistics(d, "text", ["id", "lang", "source", "text_hash"])
    d = d.select("*", *[F.expr(f"CAST(floor(({x}) * {GRID} + 0.5) AS BIGINT)").alias(f"x{i}") for i, x in enumerate(VECTOR)])
    d = scratch.keep(d, "statistics")
    d = _group_keys(d, least_rows, scratch)
    rows = d.where(f"NOT {BASE_FAILED} AND g IS NOT NULL").select("g", *[f"x{i}" for i in DIMS])
    params = _medians(rows).select("g", *[f"m{i}" for i in DIMS], *[
        F.lit(SCALES[i] if i == j else 0.0).alias(f"l{i}{j}") for i, j in PAIRS])
    params = scratch.keep(params, "params-0")
    for k in range(steps):
        last = k == steps - 1
        params = scratch.keep(_concentrate(rows, params, share, CONSISTENCY if last else 1.0), f"params-{k + 1}")
    out = _add(d.join(params, "g", "left"), distance_steps())
    return out.select(
        F.col("id").alias(id_col), *STATS, F.expr(BASE_FAILED).alias("base_failed"), F.col("d2").alias("distance"),
        F.expr(f"NOT {BASE_FAILED} AND coalesce(d2 <= {cutoff}, true)").alias("kept"), "text_hash")


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    i, h, mine = fresh(docs, "_i", "_h", "_mine")
    verdicts = judge(docs, id_col=id_col, text_col=text_col, **options)
    good = verdicts.where("kept").select(F.col(id_col).alias(i), F.col("text_hash").alias(mine)).distinct()
    d = docs.withColumn(h, F.xxhash64(text_col))
    return d.join(good, d[id_col].eqNullSafe(good[i]) & (d[h] == good[mine]), "left_semi").select(*[d[c] for c in docs.columns])


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for the contract's columns."""
    xs = ", ".join(f"CAST(floor(({x}) * {GRID} + 0.5) AS BIGINT) AS x{i}" for i, x in enumerate(VECTOR))
    sql = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT r, sum(least(5, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9) AS before FROM twice) GROUP BY r),
st AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
              (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
              (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
       FROM w LEFT JOIN cover ON cover.r = w.r),
v AS (SELECT *, {xs}, {BASE_FAILED} AS base_failed FROM st),
z1 AS (SELECT lang, source, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
z2 AS (SELECT *, sum(CASE WHEN n < {LEAST_ROWS} THEN n END) OVER (PARTITION BY lang) AS nl FROM z1),
z3 AS (SELECT *, sum(CASE WHEN n < {LEAST_ROWS} AND nl < {LEAST_ROWS} THEN n END) OVER () AS na FROM z2),
z AS (SELECT lang, source, CASE WHEN n >= {LEAST_ROWS} THEN '1' || to_json([lang, source])::VARCHAR WHEN nl >= {LEAST_ROWS} THEN '2' || to_json([lang])::VARCHAR
                                WHEN na >= {LEAST_ROWS} THEN '3' END AS g FROM z3),
k AS (SELECT v.*, z.g FROM v LEFT JOIN z ON v.lang IS NOT DISTINCT FROM z.lang AND v.source IS NOT DISTINCT FROM z.source),
u AS (SELECT * FROM k WHERE NOT base_failed AND g IS NOT NULL),
p0 AS (SELECT g, {", ".join(f"quantile_disc(x{i}, 0.5) / {GRID}e0 AS m{i}" for i in DIMS)},
              {", ".join(f"CAST({SCALES[i] if i == j else 0.0} AS DOUBLE) AS l{i}{j}" for i, j in PAIRS)} FROM u GROUP BY g)"""

    def chain(name: str, start: str, steps: list[tuple[str, str]]) -> str:
        out, at = "", start
        for n, (col, e) in enumerate(steps):
            out += f",\n{name}_{n} AS (SELECT *, {e} AS {col} FROM {at})"
            at = f"{name}_{n}"
        return out + f",\n{name} AS (SELECT * FROM {at})"

    for s in range(STEPS):
        mean, cov = moments(CONSISTENCY if s == STEPS - 1 else 1.0)
        params = f"m0, m1, m2, m3, {', '.join(f'l{i}{j}' for i, j in PAIRS)}"
        sql += f",\na{s} AS (SELECT u.*, {params} FROM u JOIN p{s} USING (g))"
        sql += chain(f"b{s}", f"a{s}", distance_steps())
        sums = [f"s{i}" for i in DIMS] + [f"p{i}{j}" for i, j in PAIRS]
        parts = [f"sum(x{i}) AS s{i}" for i in DIMS] + [f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in PAIRS]
        sql += f",\nc{s} AS (SELECT g, {BIN} AS bin, count(*) AS n, {', '.join(parts)} FROM b{s} GROUP BY ALL)"
        sql += f",\ne{s} AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY g) AS whole FROM c{s})"
        sql += f",\nf{s} AS (SELECT g, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in sums)} FROM e{s} WHERE before < {SHARE} * whole GROUP BY g)"
        sql += chain(f"h{s}", f"f{s}", mean + cov + cholesky_steps())
        sql += f",\np{s + 1} AS (SELECT g, {params} FROM h{s})"
    sql += f",\nq AS (SELECT k.*, {params} FROM k LEFT JOIN p{STEPS} USING (g))" + chain("o", "q", distance_steps())
    return sql + f"\nSELECT doc_id, {', '.join(STATS)}, base_failed, NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept FROM o"
