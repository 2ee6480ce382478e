"""Operator 9: quality selection by importance resampling.

Two generative models over hashed word n-grams (single words and pairs, in
``BUCKETS`` buckets): one of target text, one of all text.  A document's log weight is
the log ratio of its probabilities under the two.  Documents are sampled without
replacement in proportion to the weights by the Gumbel trick: each gets a Gumbel
number, seeded by its id and text, and the ``k`` largest sums of log weight and
number are kept.

The target model is fitted on a bounded sample of labelled documents
(``MOST_TARGET`` ids by hash, broadcast); the model of all text counts every document.
Both are sums by bucket, so what reaches the driver is one row per bucket.  The
k-th largest key is found by counting keys in ever narrower ranges.

Defined results: a null or empty text has no n-grams and weight 0; rows equal in
id and text share their Gumbel number and are kept or left together (so ties at
the k-th key may keep a few more than k); label rows without a document, or with
a null id, are unused; extra columns are ignored; an empty table gives an empty
result; without target labels all weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary
from .jaccard_join import _mix, word_hashes

BUCKETS = 10_000
MOST_TARGET = 20_000
SMOOTHING = 1.0
SEED = 11
FEW = 5_000                 # keys of the last range that may be looked at one by one


def buckets(text: bytes, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the text's words and word pairs."""
    w = word_hashes(text)
    pairs = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] + np.uint64(1)
    return (_mix(np.concatenate([w, pairs])) % np.uint64(n_buckets)).astype(np.int64)


def _counts(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
                b = np.bincount(buckets(text, n_buckets), minlength=n_buckets)
                total += b
                if is_target:
                    target += b
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(target[used])], names=["bucket", "total", "target"])
    return run


def _weights(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for text in batch.column("text").to_pylist():
                b = buckets(text, len(ratio))
                n.append(len(b))
                weight.append(float(ratio[b].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("noise"), pa.array(n, pa.int64()), pa.array(weight, pa.float64())],
                                             names=["id", "noise", "n_grams", "log_weight"])
    return run


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (k >= 1, at most the rows) by counts in ranges."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    above = 0                               # values over hi
    while True:
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (hi - lo) / 1000
        if width <= 0 or lo + width == lo:
            return lo
        bins = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(999)).alias("b")) \
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in bins:                      # at most 1,000 rows
            if above + r["n"] >= k:
                break
            above += r["n"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi:
            return lo
        if r["n"] <= FEW:
            found = df.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()
            return sorted((x[0] for x in found), reverse=True)[k - above - 1]


def resample(docs: DataFrame, target_ids: DataFrame, *, share: float, id_col: str = "doc_id", text_col: str = "text",
             n_buckets: int = BUCKETS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_grams, log_weight, kept): keeps ``share`` of the documents.

    ``target_ids``: one column, the ids of target documents."""
    scratch = scratch or Scratch(docs.sparkSession, "importance")
    name = target_ids.columns[0]
    sample = target_ids.select(F.col(name).alias("target")).where("target IS NOT NULL").distinct() \
        .orderBy(F.xxhash64("target"), "target").limit(MOST_TARGET)
    d = docs.select(F.col(id_col).alias("id"), binary(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("u"))
    marked = d.select("id", "text").join(F.broadcast(sample), F.col("id") == F.col("target"), "left") \
        .select("text", F.col("target").isNotNull().alias("target"))
    rows = marked.mapInArrow(_counts(n_buckets), "bucket long, total long, target long").groupBy("bucket") \
        .agg(F.sum("total").alias("total"), F.sum("target").alias("target")).collect()          # at most n_buckets rows
    total, target = np.full(n_buckets, SMOOTHING), np.full(n_buckets, SMOOTHING)
    for r in rows:
        total[r["bucket"]] += r["total"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(total / total.sum())
    if target.sum() == SMOOTHING * n_buckets:
        ratio[:] = 0.0
    # a Gumbel number from the hash: u in (0, 1)
    uniform = (F.shiftrightunsigned("u", 12).cast("double") + 0.5) / float(1 << 52)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = d.select("id", "text", (-F.log(-F.log(uniform))).alias("noise")) \
        .mapInArrow(_weights(ratio), f"id {kind}, noise double, n_grams long, log_weight double") \
        .withColumn("key", F.col("log_weight") + F.col("noise"))
    scored = scratch.keep(scored, "scored")
    k = round(share * scored.count())
    cut = kth_largest(scored, "key", k) if k else float("inf")
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", (F.col("key") >= cut).alias("kept"))
