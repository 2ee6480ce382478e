"""Registered queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ball_search, embedding_dedup, hmm_scoring, importance, jaccard_join, line_templates, packing, part_codes, quality_rules,
               source_mixing, toxicity, url_filters, warc_revisits)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f
    return register


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
""")
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(line_templates.oracle())
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs, n_lines="n_lines", n_dropped="n_dropped") \
        .select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


@query()
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query(quality_rules.oracle())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


# What SQL can say of op7's result: all but the shards, which its tree draws (tests/llm holds them).
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CASE WHEN text IS NULL THEN 'null' ELSE md5(text) END) || 'mix-1') AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * words / weight, source NULLS LAST) AS pos FROM s),
f AS (SELECT 0::BIGINT AS pos, 1.5 * (SELECT sum(words) FROM s)::DOUBLE AS total, (SELECT sum(weight) FROM s) AS weight, 0.0::DOUBLE AS target
      UNION ALL
      SELECT o.pos, f.total - least(2.0 * o.words, f.total * o.weight / f.weight), f.weight - o.weight,
             least(2.0 * o.words, f.total * o.weight / f.weight)
      FROM f JOIN o ON o.pos = f.pos + 1),
t AS (SELECT o.source, o.words, f.target, CASE WHEN o.words > 0 THEN floor(f.target / o.words) ELSE 0 END AS whole FROM o JOIN f ON o.pos = f.pos),
r AS (SELECT d.doc_id, d.size, t.words, t.target, t.whole, t.target - t.whole * t.words AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query()
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents")) \
        .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.score_texts(table(spark, sf_dir, "documents"))


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps the share of documents that the labels call good, resampled towards
    documents that are good and not toxic."""
    labels = table(spark, sf_dir, "labels")
    share = labels.agg(F.coalesce(F.avg((F.col("quality") == 1).cast("int")), F.lit(1.0))).first()[0]
    target = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), target, share=share)


@query(r"""
WITH p AS (SELECT *, '"' || substr(md5(html), 1, 16) || '"' AS tag, page_id % 3 = 0 AS third,
                  lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || ' Jan 2024 00:00:00 GMT' AS modified FROM pages),
c AS (SELECT page_id * 4 AS id, true AS f, page_id * 60 AS t, url AS uri, tag, modified, length(html)::VARCHAR AS len, third FROM p
      UNION ALL SELECT page_id * 4 + 1, false, page_id * 60 + 86400, url || '#again', tag, NULL, NULL, third FROM p
      UNION ALL SELECT page_id * 4 + 2, false, page_id * 60 + 172800, url, CASE WHEN third THEN NULL ELSE '"other"' END,
                       CASE WHEN third THEN modified END, NULL, third FROM p
      UNION ALL SELECT page_id * 4 + 3, false, page_id * 60 - 3600, url, tag, NULL, NULL, third FROM p),
x AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(uri, '^[^/?#]*?://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')
             || regexp_replace(regexp_extract(uri, '^[^/?#]*?://[^/?#]*([^?#]*)', 1), '/$', '') AS hp,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(uri, '^[^#?]*\?([^#]*)', 1), '&'),
               lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)(=|$)'))), '&') AS q FROM c),
u AS (SELECT *, CASE WHEN contains(uri, '://') THEN hp || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS cu FROM x),
l AS (SELECT *, last_value(CASE WHEN f THEN id END IGNORE NULLS) OVER (PARTITION BY cu ORDER BY t, f, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM u),
j AS (SELECT l.*, r.tag AS rtag, r.modified AS rmod, r.len AS rlen FROM l LEFT JOIN u r ON r.id = l.rid WHERE NOT l.f),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'etag_mismatch' END
                     WHEN modified = rmod THEN 'resolved' ELSE 'date_mismatch' END AS status FROM j)
SELECT id AS record_id, cu AS canonical_url, status, rid AS response_id,
       CASE WHEN id % 4 = 1 THEN CASE WHEN status = 'resolved'
              THEN 'cache-control=max-age=600;content-length=' || rlen || ';content-type=text/html;etag=W/' || tag || ';last-modified=' || rmod || ';x-revisit=1'
              ELSE 'cache-control=max-age=600;content-length=0;etag=W/' || tag || ';x-revisit=1' END
            WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-length=' || rlen || ';content-type=text/html;'
              || CASE WHEN id % 4 = 2 THEN 'date=later;' ELSE '' END || 'etag=' || rtag || ';last-modified=' || rmod
            WHEN id % 4 = 2 THEN 'date=later;' || CASE WHEN third THEN 'last-modified=' || modified ELSE 'etag=' || tag END
            ELSE 'etag=' || tag END AS headers
FROM s
""")
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(lines, ";"))


@query(part_codes.oracle())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.encode_vectors(table(spark, sf_dir, "embeddings"))


@query(ball_search.ORACLE)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
