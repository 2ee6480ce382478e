"""Registered listing queries.

Two families of listings, one output each:
* ``pages-<lang>``: a ``<lang>:`` section header, then the URL paths (query and
  fragment removed) of the pages of that language segment, by page id;
* ``parts-<brand>``: part names by part key as ``parts/<name>`` plus ``/`` for
  size < 5 (directories), nothing for size 5-9, ``.<type>`` otherwise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.listing import compact_listing, dedup_listing, group_label, parse_listing
from ..operators.scan import CHUNK_COL, segmented_scan
from .catalog import register, with_ctes
from .inputs import table

_PATH_RE = "^https?://[^/]+(/[^?#]*)"
_LANG_RE = "^https?://[^/]+/([a-z]+)/"


def listing_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages-"), F.regexp_extract("url", _LANG_RE, 1)).alias("output_id"),
        F.col("page_id").alias("pos"), F.regexp_extract("url", _PATH_RE, 1).alias("entry"))
    name = F.concat(F.lit("parts/"), F.regexp_replace("p_name", " ", "_"))
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("parts-"), F.col("p_brand")).alias("output_id"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") < 5, F.concat(name, F.lit("/"))).when(F.col("p_size") < 10, name)
        .otherwise(F.concat(name, F.lit("."), F.lower("p_type"))).alias("entry"))
    body = segmented_scan(pages.unionByName(parts), ["output_id"], "pos",
                          running_sum={"_r": F.lit(1)}).drop(CHUNK_COL)
    body = body.select("output_id", F.col("_r").cast("int").alias("line_no"),
                       F.concat(F.col("entry"), F.lit("\n")).alias("line"))
    heads = pages.select("output_id").distinct().select(
        "output_id", F.lit(0).alias("line_no"),
        F.concat(F.regexp_replace("output_id", "^pages-", ""), F.lit(":\n")).alias("line"))
    first = body.unionByName(heads)
    # parts listings have no header: shift them to start at 0
    return first.select("output_id", F.when(F.col("output_id").startswith("parts-"), F.col("line_no") - 1)
                        .otherwise(F.col("line_no")).cast("int").alias("line_no"), "line")


_WS = "[ \\t\\n\\r\\x0b\\f]"
_LONG = "^(?:[bcdlps-][rwxStTs-]{9}|[bcdlps-][rwxStTs-]{10}|\\S+[+@]?)\\s+\\d+\\s+"

_SQL_LISTING = f"""
_ent AS (
  SELECT 'pages-' || regexp_extract(url, '{_LANG_RE}', 1) AS output_id, page_id AS pos,
         regexp_extract(url, '{_PATH_RE}', 1) AS entry FROM pages
  UNION ALL
  SELECT 'parts-' || p_brand, p_partkey,
         CASE WHEN p_size < 5 THEN 'parts/' || replace(p_name, ' ', '_') || '/'
              WHEN p_size < 10 THEN 'parts/' || replace(p_name, ' ', '_')
              ELSE 'parts/' || replace(p_name, ' ', '_') || '.' || lower(p_type) END
  FROM part
),
lst AS (
  SELECT output_id, CAST(row_number() OVER (PARTITION BY output_id ORDER BY pos)
                         - CASE WHEN starts_with(output_id, 'parts-') THEN 1 ELSE 0 END AS INTEGER) AS line_no,
         entry || chr(10) AS line
  FROM _ent
  UNION ALL
  SELECT DISTINCT output_id, 0, replace(output_id, 'pages-', '') || ':' || chr(10) FROM _ent WHERE starts_with(output_id, 'pages-')
),
_p AS (
  SELECT *, regexp_replace(regexp_replace(line, '[\\n\\r]+$', ''), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM lst
),
_parsed AS (
  SELECT output_id, line_no, line, CASE WHEN s <> '' AND NOT ends_with(s, ':') THEN s END AS entry,
         s <> '' AND (starts_with(s, 'total ') OR regexp_matches(s, '{_LONG}')) AS pt
  FROM _p
),
_facts AS (SELECT output_id, bool_or(pt) AS passthrough, count(*) AS n_lines FROM _parsed GROUP BY output_id),
uniq AS (
  SELECT output_id, entry, min(line_no) AS first_line FROM _parsed WHERE entry IS NOT NULL GROUP BY output_id, entry
),
_lab AS (
  SELECT *, CASE WHEN ends_with(entry, '/') THEN '[dir]'
                 WHEN NOT contains(regexp_extract(regexp_replace(entry, '/+$', ''), '([^/]*)$', 1), '.')
                      OR ends_with(regexp_extract(regexp_replace(entry, '/+$', ''), '([^/]*)$', 1), '.') THEN '[no extension]'
                 ELSE lower('.' || regexp_extract(regexp_replace(entry, '/+$', ''), '([^.]*)$', 1)) END AS label
  FROM uniq
),
_groups AS (
  SELECT output_id, label, count(*) AS size FROM _lab GROUP BY output_id, label
),
_g AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY size DESC, label) AS g FROM _groups),
_s AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.output_id, l.label ORDER BY l.first_line) AS n FROM _lab l
),
_s2 AS (
  SELECT s.*, g.g, row_number() OVER (PARTITION BY s.output_id ORDER BY s.n, g.g) AS p
  FROM _s s JOIN _g g ON g.output_id = s.output_id AND g.label = s.label WHERE s.n <= 4
),
samples AS (SELECT * FROM _s2 WHERE p <= 40),
_taken AS (SELECT output_id, label, count(*) AS taken FROM samples GROUP BY output_id, label),
_gp AS (
  SELECT g.*, t.taken, g.size - t.taken AS omitted,
         1 + t.taken + CASE WHEN g.size > t.taken THEN 1 ELSE 0 END AS nrows
  FROM _g g JOIN _taken t ON t.output_id = g.output_id AND t.label = g.label
),
_gp2 AS (
  SELECT *, coalesce(sum(nrows) OVER (PARTITION BY output_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
         AS before
  FROM _gp
),
_tot AS (SELECT output_id, sum(nrows) + 1 AS glen, sum(taken) AS kept FROM _gp GROUP BY output_id),
_ng AS (SELECT output_id, count(*) AS n_groups FROM _groups GROUP BY output_id),
_nu AS (SELECT output_id, count(*) AS n_unique FROM uniq GROUP BY output_id),
mode AS (
  SELECT f.output_id, coalesce(u.n_unique, 0) AS n_unique, t.kept, ng.n_groups,
         CASE WHEN f.passthrough OR (coalesce(u.n_unique, 0) = f.n_lines AND coalesce(u.n_unique, 0) <= 40) THEN 'verbatim'
              WHEN coalesce(u.n_unique, 0) <= 40 THEN 'unique'
              WHEN t.glen >= u.n_unique THEN 'head' ELSE 'grouped' END AS mode
  FROM _facts f LEFT JOIN _nu u ON u.output_id = f.output_id LEFT JOIN _tot t ON t.output_id = f.output_id
  LEFT JOIN _ng ng ON ng.output_id = f.output_id
),
listing_out AS (
  SELECT p.output_id, CAST(p.line_no AS BIGINT) AS seq, 'line' AS kind, p.line_no AS src_line_no, p.line,
         CAST(0 AS BIGINT) AS n_omitted
  FROM _parsed p JOIN mode m ON m.output_id = p.output_id WHERE m.mode = 'verbatim'
  UNION ALL
  SELECT u.output_id, CAST(u.r - 1 AS BIGINT), 'line', u.first_line, u.entry || chr(10),
         CAST(CASE WHEN m.mode = 'head' AND u.r = 40 THEN m.n_unique - 40 ELSE 0 END AS BIGINT)
  FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY first_line) AS r FROM uniq) u
  JOIN mode m ON m.output_id = u.output_id WHERE m.mode IN ('unique', 'head') AND u.r <= 40
  UNION ALL
  SELECT output_id, CAST(0 AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# linesift: kept ' || CAST(kept AS VARCHAR) || '/' || CAST(n_unique AS VARCHAR) || ' unique entries across '
         || CAST(n_groups AS VARCHAR) || ' groups' || chr(10), CAST(n_unique - kept AS BIGINT)
  FROM mode WHERE mode = 'grouped'
  UNION ALL
  SELECT g.output_id, CAST(g.before AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# ' || g.label || ': ' || CAST(g.size AS VARCHAR) || ' entries' || chr(10), CAST(0 AS BIGINT)
  FROM _gp2 g JOIN mode m ON m.output_id = g.output_id WHERE m.mode = 'grouped'
  UNION ALL
  SELECT g.output_id, CAST(g.before + g.taken + 1 AS BIGINT), 'note', CAST(NULL AS INTEGER),
         '# ... ' || CAST(g.omitted AS VARCHAR) || ' more ' || g.label || ' entries omitted' || chr(10), CAST(g.omitted AS BIGINT)
  FROM _gp2 g JOIN mode m ON m.output_id = g.output_id WHERE m.mode = 'grouped' AND g.omitted > 0
  UNION ALL
  SELECT s.output_id, CAST(g.before + s.n AS BIGINT), 'line', s.first_line, s.entry || chr(10), CAST(0 AS BIGINT)
  FROM samples s JOIN _gp2 g ON g.output_id = s.output_id AND g.label = s.label
  JOIN mode m ON m.output_id = s.output_id WHERE m.mode = 'grouped'
)"""


@register("listing_sample", with_ctes(_SQL_LISTING) + """
SELECT * FROM listing_out""")
def listing_sample(spark, sf_dir):
    """T7 + T8 + T9 on the derived listings."""
    return compact_listing(listing_lines(spark, sf_dir))


@register("listing_groups", with_ctes(_SQL_LISTING) + """
SELECT output_id, label, CAST(count(*) AS BIGINT) AS entries, min(first_line) AS first_line FROM _lab
GROUP BY output_id, label""")
def listing_groups(spark, sf_dir):
    """T8 + E9: unique entries per extension label."""
    u = dedup_listing(parse_listing(listing_lines(spark, sf_dir)))
    return (u.withColumn("label", group_label(F.col("entry"))).groupBy("output_id", "label")
            .agg(F.count(F.lit(1)).alias("entries"), F.min("first_line").alias("first_line")))
