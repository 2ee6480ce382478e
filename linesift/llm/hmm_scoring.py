"""Operator 10: language-model scores by a hidden Markov model.

1. Counting.  Every partition counts its training tokens; the counts are summed by
   word over the whole corpus.  The ``head`` most frequent words (a parameter, so
   a proven bound) are known to every task; all other words share one class.
2. A document becomes the sequence of its word classes, written once.
3. Baum-Welch.  The model has ``states`` latent states with transition
   probabilities and emission probabilities over the classes.  In every round the
   partitions run forward and backward over their sequences and return expected
   counts, which are summed by class over all training documents.
4. Scoring.  The scaled forward recursion over the whole sequence gives its exact
   likelihood under the model; documents of a batch step together, longest first.
   A word outside the head has, within its class, the probability (c + 1) / (C + R + 1)
   with its count c, all counts C and the R different words of the class; these
   factors do not depend on the state, so they are joined by word and added.

The head is a bound on what is broadcast, not on the vocabulary: the counts of
all other words stay distributed and meet their documents in a join.  Training
cuts sequences at ``SEGMENT`` tokens; scoring never cuts.

Defined results: a null or empty text is one end token; a null id trains; rows
equal in id and text score alike (each row has its result); extra columns are
ignored; an empty table gives an empty result, and a table without training
documents scores every token as unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary

STATES = 8
HEAD = 50_000               # words that every task knows
ROUNDS = 4
SEGMENT = 512
SEED_DOCS = 64              # training documents (about) that the first states are made from
TRANSITION_PRIOR, EMISSION_PRIOR = 0.1, 0.5
COUNTED = 300_000           # different words that a task counts before it passes them on
BATCH_TOKENS = 300_000


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, remainder 2 of 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                                         names=["word", "n"])
        seen.clear()
        return got

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(text.lower().split())
            seen[b""] += 1          # the end token; no word is empty
            if len(seen) > COUNTED:
                yield out()
    if seen:
        yield out()


def _head_bin(bins: list[tuple[int, int]], head: int) -> int:
    """Least bin of counts (1/16 of a power of two wide) so that the words in it and
    above are at most ``head``: these go to the driver whole, and the first words of
    the bins below fill up the head."""
    total, cut = 0, max((b for b, _ in bins), default=0) + 1
    for b, n in sorted(bins, reverse=True):
        total += n
        if total > head:
            break
        cut = b
    return cut


def _encode(head: list[str]):
    """Rows: the class sequence, and the words outside the head with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w.encode(): k for k, w in enumerate(head)}
        tail = len(head)
        end = known.get(b"", tail)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                seqs, words, times, n_tokens = [], [], [], []
                for text in batch.column("text").to_pylist():
                    tokens = text.lower().split()
                    n = len(tokens)
                    seq = np.fromiter((known.get(t, tail) for t in tokens), "<i4", n)
                    rare = Counter(tokens[k] for k in np.flatnonzero(seq == tail))
                    if end == tail:
                        rare[b""] += 1
                    seqs.append(np.append(seq, np.int32(end)).astype("<i4").tobytes())
                    words.append([w.decode() for w in rare])
                    times.append(list(rare.values()))
                    n_tokens.append(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), batch.column("held"), pa.array(n_tokens, pa.int64()), pa.array(seqs, pa.binary()),
                     pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "id", "held", "n_tokens", "seq", "words", "times"])
    return run


class Model:
    """Start, transition and emission probabilities; emission is class x state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def _stacked(seqs: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences, longest first: (which, tokens in step order, live rows of each step)."""
    order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    at = 0
    while at < len(order):
        n, tokens = at, 0
        while n < len(order) and (n == at or tokens < limit):
            tokens += len(seqs[order[n]])
            n += 1
        part = [seqs[k] for k in order[at:n]]
        length = np.array([len(s) for s in part])
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        begin = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty(begin[-1], np.int32)
        for k, s in enumerate(part):
            flat[begin[:len(s)] + k] = s
        yield np.array(order[at:n]), flat, live
        at = n


def log_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of every class sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for which, flat, live in _stacked(seqs, 16 * BATCH_TOKENS):
        total = np.zeros(len(which))
        alpha, at = None, 0
        for n in live:
            e = model.emit[flat[at:at + n]]
            alpha = (model.start if alpha is None else alpha[:n] @ model.move) * e
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
            at += n
        out[which] = total
    return out


def expected_counts(model: Model, seqs: list[np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of sequences: start, transitions, emissions (class x state), and their log likelihood."""
    k = len(model.start)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), 0.0
    for _, flat, live in _stacked(seqs, BATCH_TOKENS):
        begin = np.concatenate([[0], np.cumsum(live)])
        alpha, scale = np.empty((len(flat), k)), np.empty(len(flat))
        seen = model.emit[flat]
        for t, n in enumerate(live):
            a, b = begin[t], begin[t + 1]
            x = (np.broadcast_to(model.start, (n, k)) if not t else alpha[begin[t - 1]:begin[t - 1] + n] @ model.move) * seen[a:b]
            scale[a:b] = x.sum(axis=1)
            alpha[a:b] = x / scale[a:b, None]
        total += float(np.log(scale).sum())
        beta = np.ones((live[-1], k))
        gamma = np.empty_like(alpha)
        for t in range(len(live) - 1, -1, -1):
            a, b, n = begin[t], begin[t + 1], live[t]
            if len(beta) < n:               # sequences that end here
                beta = np.concatenate([beta, np.ones((n - len(beta), k))])
            gamma[a:b] = alpha[a:b] * beta
            if t:
                ahead = seen[a:b] * beta / scale[a:b, None]
                move += alpha[begin[t - 1]:begin[t - 1] + n].T @ ahead
                beta = ahead @ model.move.T
        start += gamma[:live[0]].sum(axis=0)
        for s in range(k):
            emit[:, s] += np.bincount(flat, gamma[:, s], classes)
    return start, move * model.move, emit, total


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s, "<i4") for s in batch.column("seq").to_pylist()]


def _expect(model: Model, classes: int):
    """One row per class (and -1 start, -2-i transitions from state i) with the partition's expected counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                seqs = [s[a:a + SEGMENT] for s in _sequences(whole.slice(at, 2000)) for a in range(0, len(s), SEGMENT)]
                a, b, c, _ = expected_counts(model, seqs, classes)
                start += a
                move += b
                emit += c
        used = np.flatnonzero(emit.sum(axis=1))
        keys = np.concatenate([[-1], -2 - np.arange(k), used])
        values = np.concatenate([start[None, :], move, emit[used]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())] + [pa.array(np.ascontiguousarray(values[:, s])) for s in range(k)],
                                         names=["key", *[f"s{s}" for s in range(k)]])
    return run


def first_model(states: int, unigram: np.ndarray, seeds: list[np.ndarray]) -> Model:
    """States that start from the words of seed documents that are far apart."""
    k, classes = states, len(unigram)
    emit = np.tile(unigram[:, None], (1, k))
    found: list[np.ndarray] = []
    hists = []
    for s in seeds:
        h = np.bincount(s, minlength=classes).astype(float)
        h[unigram > 0.01] = 0               # the most common classes say nothing
        if h.any():
            hists.append(h / np.sqrt((h * h).sum()))
    near = np.zeros(len(hists))
    for s in range(min(k, len(hists))):
        at = int(np.argmin(near))
        found.append(hists[at])
        near = np.maximum(near, [h @ hists[at] for h in hists])
        near[at] = 2
    for s in range(k):
        own = found[s % len(found)] if found else unigram
        emit[:, s] = 0.7 * unigram + 0.3 * own / own.sum()
        if s >= len(found):                 # fewer seeds than states: tell them apart a little
            emit[:, s] *= 1 + 0.1 * np.cos(np.arange(classes) * (s + 1))
            emit[:, s] /= emit[:, s].sum()
    move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(move, 0.9)
    return Model(np.full(k, 1 / k), move, emit)


def train(seqs: DataFrame, classes: int, unigram: np.ndarray, *, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over ``seqs`` (seq: class ids as int32 bytes).  A round moves
    classes x states sums to the driver, whatever the corpus."""
    some = seqs.orderBy(F.xxhash64("row")).limit(SEED_DOCS).select("seq").collect()
    model = first_model(states, unigram, [np.frombuffer(r["seq"], "<i4")[:20_000] for r in some])
    names = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        sums = seqs.select("seq").mapInArrow(_expect(model, classes), "key long, " + ", ".join(f"{c} double" for c in names)) \
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values("key")
        if not len(sums):
            break
        got = dict(zip(sums["key"], sums[names].to_numpy()))
        start = got[-1] + TRANSITION_PRIOR
        move = np.array([got[-2 - s] for s in range(states)]) + TRANSITION_PRIOR
        emit = EMISSION_PRIOR * states * np.tile(unigram[:, None], (1, states))
        rows = sums["key"].to_numpy()
        emit[rows[rows >= 0]] += sums[names].to_numpy()[rows >= 0]
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def _score(model: Model, base: np.ndarray, known: np.ndarray):
    """Forward scores; the head's part of the unigram score and of the known tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                seqs = _sequences(batch)
                ends = np.cumsum([len(s) for s in seqs])
                flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
                first = np.concatenate([[0], ends])[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("row", "id", "held", "n_tokens")]
                    + [pa.array(log_likelihood(model, seqs) / math.log(10)),
                       pa.array(np.add.reduceat(base[flat], first) if seqs else base[:0]),
                       pa.array(np.add.reduceat(known[flat], first) if seqs else known[:0])],
                    names=["row", "id", "held", "n_tokens", "hmm", "base", "known"])
    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, head: int = HEAD,
                rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    scratch = scratch or Scratch(docs.sparkSession, "hmm")
    # rows equal in id and text share a key and a score, so a key's rows need not be told apart
    d = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), held_out(id_col).alias("held"),
                    binary(text_col).alias("text"))
    counts = d.where("NOT held").select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = scratch.keep(counts, "counts")
    all_tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    counts = counts.withColumn("bin", F.floor(16 * F.log2("c")).cast("int"))
    cut = _head_bin([(r["bin"], r["n"]) for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()], head)
    top = sorted(((r["c"], r["word"]) for r in counts.where(F.col("bin") >= cut).collect()), key=lambda r: (-r[0], r[1]))
    below = counts.where(F.col("bin") < cut).orderBy(F.desc("c"), "word")
    edge = below.limit(head - len(top)).collect() if len(top) < min(head, vocabulary) else []      # the rest of the head, in the same order
    top += [(r["c"], r["word"]) for r in edge]
    words, c = [w for _, w in top], np.array([n for n, _ in top], np.float64)      # at most ``head`` of them
    tail_tokens, tail_words = all_tokens - int(c.sum()), vocabulary - len(words)
    kind = docs.schema[id_col].dataType.simpleString()
    seqs = scratch.keep(d.mapInArrow(
        _encode(words), f"row long, id {kind}, held boolean, n_tokens long, seq binary, words array<string>, times array<long>"), "sequences")

    classes = len(words) + 1
    unigram = np.append(c, tail_tokens) + 0.5
    unigram /= unigram.sum()
    model = train(seqs.where("NOT held"), classes, unigram, states=states, rounds=rounds)
    floor = all_tokens + (vocabulary + 1)
    base = np.append(np.log10((c + 1) / floor), 0.0)
    known = np.append(np.ones(len(c), np.int64), 0)
    scored = seqs.select("row", "id", "held", "n_tokens", "seq").mapInArrow(
        _score(model, base, known), f"row long, id {kind}, held boolean, n_tokens long, hmm double, base double, known long")

    # words outside the head: their factors by a join with the corpus counts
    last = edge[-1] if edge else None
    rest = counts.where(F.col("bin") < cut)
    if last:
        rest = rest.where((F.col("c") < last["c"]) | (F.col("c") == last["c"]) & (F.col("word") > last["word"]))
    rest = rest.select("word", "c")
    rare = seqs.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")) \
        .select("row", F.col("z.words").alias("word"), F.col("z.times").alias("k"))
    n = F.coalesce("c", F.lit(0))
    rare = rare.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10((n + 1) / F.lit(float(floor)))).alias("rare_base"),
        F.sum(F.col("k") * F.log10((n + 1) / F.lit(float(tail_tokens + tail_words + 1)))).alias("rare_score"),
        F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    copies = seqs.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")       # repeated rows

    def part(name: str) -> Column:
        return F.coalesce(F.col(name) / F.coalesce("copies", F.lit(1)), F.lit(0))

    return scored.join(rare, "row", "left").join(copies, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + part("rare_known")).cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + part("rare_base")).alias("base_score"), (F.col("hmm") + part("rare_score")).alias("score"))
