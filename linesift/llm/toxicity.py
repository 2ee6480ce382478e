"""Operator 13: toxicity by a factorization machine over hashed terms.

A text's terms are its words (runs of ASCII letters, digits and characters beyond
ASCII, A-Z lowered) and the first 5, 6 and 7 bytes of words, hashed to ``BUCKETS``.
A term's value grows with its share of the words: log(1 + 100 * count / (words + 20)).
The machine's raw score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the
factors learn pairs of terms that say more together than each does alone, which a sum
of weights cannot.  The score is its logistic function.

1. At most ``MOST_LABELLED`` labelled ids, by hash, that may be learned from are
   broadcast; one pass over the documents writes the terms of theirs.
2. By bucket, the sums over these documents give a t statistic between the classes;
   the ``TERMS`` strongest buckets that ``LEAST_DOCS`` documents have are the model's.
3. The documents' values of these terms, a few numbers each, train the machine by
   AdaGrad in a fixed order, so reruns agree.
4. One pass without a shuffle scores every whole text.

Only texts and labels make a score; which documents are held out goes by their id.

Defined results: null and empty texts have no terms and get the logistic of w0; a null
id counts as the empty text in the hold-out rule; an id with several labels is toxic
if one says so, of several documents with one id the least by its terms is learned
from; label rows with a null id or label, or without a document, are unused.  Without
labels, or with labels of one class only, every score is the share of toxic labels (0
without any).  Repeated rows get equal scores.  Extra columns are ignored; an empty
table gives an empty result.  Long texts take memory in proportion to one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TERM_BYTES, Scratch, binary
from .jaccard_join import _mix

BUCKETS = 1 << 18
GRAMS = (5, 6, 7)               # bytes at a word's start
MOST_LABELLED = 40_000          # labelled documents learned from
TERMS, LEAST_DOCS = 1024, 3
FACTORS, ROUNDS, BATCH, RATE, DECAY = 8, 8, 64, 0.1, 1e-4
FOLDS, HELD = 5, 0              # crc32(id as text) mod FOLDS = HELD is held out

BASE = 0x100000001B3            # of the polynomial hashes, modulo 2**64
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**1 ... BASE**n at least, and the same of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def term_values(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets, ascending, and their values."""
    b = np.frombuffer(b" " + text.translate(TERM_BYTES) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff((b != 32).view(np.int8))) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    power, inverse = powers(len(b))
    below = np.append(np.uint64(0), np.cumsum(b * power[:len(b)], dtype=np.uint64))
    found = [_mix((below[end] - below[start]) * inverse[start] + (end - start).astype(np.uint64))]
    for n in GRAMS:
        at = start[end - start >= n]
        found.append(_mix(((below[at + n] - below[at]) * inverse[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)))
    bucket, count = np.unique((np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int32), return_counts=True)
    return bucket.astype(np.int64), np.log1p(count * (100.0 / (len(start) + 20))).astype(np.float32)


class Machine:
    """Factorization machine over ``terms`` slots; slot ``terms`` stands for no term."""

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(terms + 1)
        self.v = rng.standard_normal((terms + 1, factors)) * 0.05

    def raw(self, slot: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of rows that begin at ``at`` (none is empty), sums of factors by
        row, and each entry's share of them."""
        vx = self.v[slot] * value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), at))
        return self.w0 + np.add.reduceat(self.w[slot] * value, at) + pairs, total, vx

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Machine:
        rng, order = np.random.default_rng(seed), np.arange(len(rows))
        sw0, sw, sv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(rounds):
            rng.shuffle(order)
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                slot, value, begin = joined([rows[k] for k in pick])
                z, total, vx = self.raw(slot, value, begin)
                off = logistic(z) - label[pick]
                row = np.repeat(np.arange(len(pick)), np.diff(np.append(begin, len(slot))))
                used, inverse = np.unique(slot, return_inverse=True)
                pull = off[row] * value
                gw = np.bincount(inverse, pull, len(used)) + DECAY * self.w[used]
                by = np.argsort(inverse, kind="stable")
                first = np.append(0, np.cumsum(np.bincount(inverse))[:-1])
                gv = np.add.reduceat((pull[:, None] * (total[row] - vx))[by], first, axis=0) + DECAY * self.v[used]
                sw0 += off.sum() ** 2
                sw[used] += gw * gw
                sv[used] += gv * gv
                self.w0 -= RATE * off.sum() / np.sqrt(sw0)
                self.w[used] -= RATE * gw / np.sqrt(sw[used])
                self.v[used] -= 0.3 * RATE * gv / np.sqrt(sv[used])
        return self


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = [len(s) for s, _ in rows]
    return np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum([0, *size[:-1]])


def chosen(bucket: np.ndarray, value: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's slots among buckets; without any, the slot for none."""
    slot = slots[bucket]
    have = slot >= 0
    if not have.any():
        return np.array([slots.max() + 1]), np.zeros(1)
    return slot[have].astype(np.int64), value[have].astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            found = [term_values(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(b) for b, _ in found)]).astype(np.int32)
            bucket, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(ends, bucket.astype(np.int32)),
                 pa.ListArray.from_arrays(ends, value)], names=["id", "label", "bucket", "value"])


def _chosen(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("bucket").value_lengths().to_numpy()
            bucket, value = (np.split(batch.column(c).flatten().to_numpy(), np.cumsum(size)[:-1]) for c in ("bucket", "value"))
            found = [chosen(b, v, slots) for b, v in zip(bucket, value)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([s for s, _ in found], pa.list_(pa.int64())),
                                              pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["id", "label", "slot", "value"])
    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, slots, constant = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if machine is None:
                    score = np.full(batch.num_rows, constant)
                else:
                    score = logistic(machine.raw(*joined([chosen(*term_values(t), slots) for t in batch.column("text").to_pylist()]))[0])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])
    return run


def held_out(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % FOLDS == HELD


def _learn(d: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, label_col: str, most: int):
    """(machine or None, slot of every bucket or -1, the score without a machine)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).alias("known")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("known"), "known").limit(most)            # bounded, so it may be broadcast
    kind = d.schema["id"].dataType.simpleString()
    rows = d.join(F.broadcast(sample), F.col("id") == F.col("known")).select("id", "label", "text") \
        .mapInArrow(_features, f"id {kind}, label int, bucket array<int>, value array<float>")
    rows = scratch.keep(rows.groupBy("id", "label").agg(F.min(F.struct("bucket", "value")).alias("x")).select("id", "label", "x.*"), "learned")
    count = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    slots = np.full(BUCKETS, -1, np.int32)
    if not n0 or not n1:
        return None, slots, n1 / max(1, n0 + n1)
    x = rows.select((F.col("label") == 1).alias("toxic"), F.explode(F.arrays_zip("bucket", "value")).alias("x")).select("toxic", "x.*")
    value = F.col("value").cast("double")
    sums = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("toxic"), value).otherwise(0.0)).alias("s1"),
                                   F.sum(F.when(~F.col("toxic"), value).otherwise(0.0)).alias("s0"), F.sum(value * value).alias("q"))
    n = n0 + n1
    spread = F.col("q") / n - ((F.col("s0") + F.col("s1")) / n) ** 2 + 1e-4
    t = F.abs(F.col("s1") / n1 - F.col("s0") / n0) / F.sqrt(spread)
    best = sums.where(F.col("docs") >= LEAST_DOCS).select("bucket", F.round(t, 9).alias("t")).orderBy(F.desc("t"), "bucket").limit(TERMS).collect()
    slots[sorted(r["bucket"] for r in best)] = np.arange(len(best))
    few = rows.mapInArrow(_chosen(slots), f"id {kind}, label int, slot array<long>, value array<double>") \
        .orderBy(F.xxhash64("id"), "id").collect()                              # at most ``most`` rows of the model's terms
    train = [(np.array(r["slot"], np.int64), np.array(r["value"])) for r in few]
    machine = Machine(len(best)).fit(train, np.array([float(r["label"] == 1) for r in few]))
    return machine, slots, 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str | None = None,
                   label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), binary(text_col).alias("text"))
    scratch = Scratch(spark, "toxicity")
    model = spark.sparkContext.broadcast(_learn(d, labels, scratch, label_id_col or id_col, label_col, most_labelled))
    scratch.drop("learned")
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_scores(model), f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
