"""Operator 8: packing documents into sequences by the configuration LP.

1. Tokenizing, per partition: a document's ids, then the end id; documents
   longer than a sequence are cut into full pieces and a rest.
2. The lengths' histogram (at most ``max_len`` rows, whatever the corpus) goes to
   the driver.  ``cover`` solves the configuration LP over it: columns are the ways
   to fill one sequence, rows the lengths to be covered.  Multiplicative weights
   price the lengths, a knapsack dynamic programme prices the columns, near-optimal
   columns are taken in steps of whole sequences, and covered lengths lose price.
   The rounding remainder (2 % of the tokens where columns stay near-optimal that
   long) is placed best-fit, in runs of equal sequences.  Duality gives a lower
   bound of the sequences beside it.
3. Pieces of one length are interchangeable: each gets a rank in its length
   (salted, so a very common length is no single task), and the plan turns
   (length, rank) into (sequence, offset) by arithmetic.

Defined results: a null text is an empty one and packs its end id alone;
repeated rows are packed repeatedly; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rank_in_group

CACHE_WORDS = 450_000          # entries of a worker's pretoken cache before it starts anew
MAX_LEN = 4096
END_ID = 1


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The vocabulary encodes pretokens (letter runs, digits, symbol runs) one by
    one, so each is encoded once and then looked up.  Plain texts (below U+0250,
    where no normal form changes a character; without the marks of added tokens
    or odd control characters) are cut into pretokens here, all others by the
    tokenizer itself.
    """

    # The vocabulary file's pretoken pattern, with its classes \p{L} and \p{N} spelled out below U+0250.
    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|[^\s\w]+(?:_+[^\s\w]*)*|_+(?:[^\s\w]+_*)*"
    ODD = r"[^\t\n\v\f\r -~\xa0-\u024f]|<\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.ascii = Tokenizer(self.tok.model)           # a byte-level vocabulary writes printable ASCII as it is
        self.inner = Tokenizer(self.tok.model)
        self.inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = re.compile(self.PRETOKEN).findall
        self.odd = re.compile(self.ODD).search
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [None if self.odd(t) else self.find(t.lower()) for t in texts]
        used = set().union(*(p for p in plain if p))
        new = used.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = used
        for tok, known in ((self.ascii, [p for p in new if p.isascii()]), (self.inner, [p for p in new if not p.isascii()])):
            self.ids.update(zip(known, (struct.pack(f"<{len(e.ids)}I", *e.ids)
                                        for e in tok.encode_batch_fast(known, add_special_tokens=False))))
        get = self.ids.__getitem__
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None
                else b"".join(map(get, p)) for t, p in zip(texts, plain)]


_ENCODERS: dict[str, Encoder] = {}          # one per Python worker, kept between its tasks


def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str | None, max_len: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, raw in enumerate(encoder.encode(batch.column("text").to_pylist())):
                    raw += end
                    for p, a in enumerate(range(0, len(raw), 4 * max_len)):
                        part = raw[a:a + 4 * max_len]
                        rows.append(k)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                cols = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return cut


def tokenize_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                    max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids as uint32 bytes])."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .mapInArrow(_pieces(tokenizer_path, max_len, end_id, with_ids), schema)


def _values(sizes: np.ndarray, prices: np.ndarray, cap: int) -> np.ndarray:
    """Knapsack dynamic programme: the best price of a filling of each room up to ``cap``."""
    best = np.zeros(cap + 1)
    fits = np.searchsorted(sizes, np.arange(cap + 1), side="right").tolist()
    for room in range(1, cap + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            best[room] = max(best[room], (best[room - sizes[:n]] + prices[:n]).max())
    return best


def _column(sizes: np.ndarray, prices: np.ndarray, left: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A well-priced filling of one sequence out of what is left: at each room the
    length that ``best`` promises most for.  (Lengths, copies, price)."""
    room, have, picks, price = len(best) - 1, left.copy(), {}, 0.0
    while n := int(np.searchsorted(sizes, room, side="right")):
        gain = np.where(have[:n] > 0, best[room - sizes[:n]] + prices[:n], -1.0)
        k = int(gain.argmax())
        if gain[k] < 0:
            break
        picks[k] = picks.get(k, 0) + 1
        have[k] -= 1
        price += float(prices[k])
        room -= int(sizes[k])
    return np.array(list(picks), np.int64), np.array(list(picks.values()), np.int64), price


class Cover(NamedTuple):
    """``runs``: (lengths as indexes, copies, sequences); ``left``: pieces of each length
    that no run places; ``bound``: no packing has fewer sequences (LP duality)."""
    sizes: np.ndarray
    runs: list[tuple[np.ndarray, np.ndarray, int]]
    left: np.ndarray
    bound: float


def cover(histogram: dict[int, int], cap: int = MAX_LEN, *, eta: float = 0.1, step: float = 0.5, rest: float = 0.02) -> Cover:
    """The configuration LP (fewest sequences whose columns cover every length as often
    as it occurs) by multiplicative weights, in whole sequences.

    A round prices the lengths and solves the knapsack once.  Then columns are taken
    while they are worth (1 - eps) of the best: prices only fall within a round, so the
    round's optimum stays an upper bound and every column taken is near-optimal for
    the prices at its time.  A step takes a column ``step`` times as often as its
    scarcest length allows, rounded down to whole sequences (one at least), and the
    lengths it covers lose price by exp(-eta * covered share): the others' prices rise
    against them.  A covered length leaves the LP.  ``eps`` grows only where a round
    places little, so a round places 2 % of what is left or brings the end at eps =
    0.1 nearer.  The loop ends when at most ``rest`` of all tokens is left: the
    rounding remainder.

    Prices p prove a bound: no column is worth more than the knapsack's optimum, so
    sum(p * demand) / optimum sequences are needed at least.
    """
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    left, runs, bound, eps = demand.copy(), [], 0.0, 0.002
    prices = (sizes / cap) ** 1.02         # near the size: every full sequence is about as good
    total = tokens = int(demand @ sizes)
    while tokens > rest * total and eps <= 0.1:
        live = np.flatnonzero(left)
        s, p, have = sizes[live], prices[live], left[live]
        best = _values(s, p, cap)
        bound = max(bound, float(p @ demand[live]) / best[cap])
        before = tokens
        while tokens > rest * total:
            at, copies, price = _column(s, p, have, best)
            if not len(at) or price < (1 - eps) * best[cap]:
                break
            n = max(1, int(step * (have[at] // copies).min()))
            runs.append((live[at], copies, n))
            have[at] -= n * copies
            tokens -= n * int(copies @ s[at])
            p[at] *= np.exp(-eta * n * copies / demand[live[at]])
        if before - tokens < 0.02 * before:
            p[at] *= 1 - eps               # its best column wants more of a length than there is
            eps *= 1.05
        left[live], prices[live] = have, p
    return Cover(sizes, runs, left, max(bound, total / cap))


def _fill(sizes: np.ndarray, left: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, int]]:
    """Best fit in runs: the largest length left, then whatever length fits the
    rest best, repeated as often as all its lengths allow."""
    have = [int(k) for k in np.flatnonzero(left)]
    keys = [int(sizes[k]) for k in have]
    while have:
        copies: dict[int, int] = {}
        room, tried = cap, len(have)
        while (at := min(tried, bisect.bisect_right(keys, room)) - 1) >= 0:
            copies[have[at]] = n = min(int(left[have[at]]), room // keys[at])
            room -= n * keys[at]
            tried = at
        runs = min(int(left[k]) // n for k, n in copies.items())
        full = np.zeros(len(sizes), np.int64)
        for k, n in copies.items():
            full[k] = n
            left[k] -= runs * n
            if not left[k]:
                i = bisect.bisect_left(keys, int(sizes[k]))
                del have[i], keys[i]
        yield full, runs


def plan_patterns(histogram: dict[int, int], cap: int = MAX_LEN, *, rest: float = 0.02) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with the number of sequences that use each;
    together they place every piece exactly once."""
    if not histogram:
        return []
    sizes, runs, left, _ = cover(histogram, cap, rest=rest)
    plan = [({int(sizes[k]): int(c) for k, c in zip(at, copies)}, n) for at, copies, n in runs]
    return plan + [({int(sizes[k]): int(c[k]) for k in np.flatnonzero(c)}, n) for c, n in _fill(sizes, left.copy(), cap)]


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """length -> arrays over its runs: first rank, first sequence, runs, offset of the first copy."""
    first: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for copies, n in patterns:
        offset = 0
        for length in sorted(copies, reverse=True):
            rows.setdefault(length, []).append((first.get(length, 0), sequence, n, offset))
            first[length] = first.get(length, 0) + n * copies[length]
            offset += length * copies[length]
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*r)) for length, r in rows.items()}


def _place(places: dict[int, tuple]):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                size = int(length[rows[0]])
                first, seq, n, off = places[size]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[run]
                sequence[rows] = seq[run] + inside % n[run]
                offset[rows] = off[run] + inside // n[run] * size
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)],
                                             names=keep + ["sequence_id", "offset"])
    return put


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                   max_len: int = MAX_LEN, end_id: int = END_ID, rest: float = 0.02) -> DataFrame:
    """Per piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(tokenize_pieces(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path,
                                          max_len=max_len, end_id=end_id), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}            # at most max_len rows
    places = _places(plan_patterns(histogram, max_len, rest=rest))
    small = spark.createDataFrame(sorted(histogram.items()), "length long, n long")
    ranked = rank_in_group(pieces, "length", small, ["id", "piece", "ids_crc32"], "_rank", hint_small=True)
    cols = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*cols, "_rank").mapInArrow(_place(places), schema).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame, pieces_with_ids: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids as uint32
    bytes in place order).  ``pieces_with_ids`` is ``tokenize_pieces(...,
    with_ids=True)`` of the same documents.  A group holds one sequence, so at
    most ``max_len`` ids."""
    one = pieces_with_ids.withColumnRenamed("id", id_col).select(id_col, "piece", "ids_crc32", "ids") \
        .dropDuplicates([id_col, "piece", "ids_crc32"])
    both = placed.alias("p").join(one.alias("o"), F.col(f"p.{id_col}").eqNullSafe(F.col(f"o.{id_col}"))
                                  & (F.col("p.piece") == F.col("o.piece")) & (F.col("p.ids_crc32") == F.col("o.ids_crc32")))
    return both.groupBy("p.sequence_id").agg(
        F.sum("p.length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("p.offset", "o.ids"))).alias("parts")) \
        .select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
