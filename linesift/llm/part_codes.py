"""Operator 11: vector codes of four parts, nearest entries by memoised grid cells.

A component x becomes the integer floor(1024 * x).  Vectors are cut into ``PARTS``
consecutive parts; each position has a codebook of at most ``ENTRIES`` entries that
starts as the parts of the smallest ids and moves to its parts' floored means in
``ROUNDS`` rounds.  A code names the nearest entry of each part.

Nearest entries are found by grid cells.  A part's cell is its components shifted
right; the first part that falls into a cell fills the cell's cache entry: the
codebook entries not dominated anywhere in the cell's box.  An entry goes when its
least distance to the box exceeds another entry's greatest distance, or when the
least difference over the box between its distance and that of the entry nearest to
the box's middle is positive.  Both bounds are exact in integers, so the nearest
entry (ties to the lower index) always stays; only entries that stay are evaluated.
The cell's width follows the spread of the codebook and changes no result.

Each round is one pass over the vectors: tasks send sums by entry and dimension
(at most ENTRIES * dimensions rows a task), the driver gets their totals, and the
next pass gets the new codebooks.  No vector is shuffled but the bounded start.

Defined results: null vectors, and vectors with a null or non-finite component, are
dropped.  The start takes the smallest distinct ids that are not null; of rows that
share one, the least vector.  All codebooks have the length of the least of these
ids' vectors; vectors of another length, or with a component too large for exact
64-bit distances (2**17 and more in 16 dimensions a part), get a null code and error
and no part in the codebooks.  A length that four does not divide makes later parts
longer by one.  Repeated rows count and come out as often as they stand.  Labels that
are null are one group.  Extra columns are ignored; an empty table gives an empty
result.  A vector is held whole, so memory grows with an Arrow batch of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CACHE_CELLS = 200_000           # cells cached for a part position; a full cache starts anew
SMALL_GROUPS = 100_000          # group totals that may be broadcast


def bounds(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def limit(dim: int, parts: int) -> int:
    """Largest component for which all distances and their sums fit 64 bits."""
    return math.isqrt((1 << 58) // max(1, -(-dim // parts) * parts // 4))


class Grid:
    """Nearest codebook entries of one part position."""

    def __init__(self, entries: np.ndarray, shift: int | None = None):
        self.e = entries
        spread = float(entries.std(axis=0).mean()) if entries.size else 0.0
        self.shift = shift if shift is not None else max(0, round(math.log2(max(spread, 1.0))) - 1)
        self.norm = (entries * entries).sum(axis=1)
        self.apart = np.stack([np.abs(entries - e).sum(axis=1) for e in entries]) if len(entries) else np.zeros((0, 0), np.int64)
        self.cells: dict[bytes, np.ndarray] = {}
        self.filled = self.evaluated = 0

    def _fill(self, cells: np.ndarray) -> list[np.ndarray]:
        """For every cell, the entries (ascending) that nothing dominates in its box."""
        width, out = (1 << self.shift) - 1, []
        for at in range(0, len(cells), 256):
            some = cells[at:at + 256].astype(np.int64)
            least, most = np.zeros((2, len(some), len(self.e)), np.int64)
            for k in range(some.shape[1]):            # distances add up by dimension; cells share coordinates
                place, row = np.unique(some[:, k], return_inverse=True)
                over = self.e[:, k] - (place << self.shift)[:, None]
                under = width - over
                least += (np.maximum(np.maximum(-over, -under), 0) ** 2)[row]
                most += (np.maximum(over, under) ** 2)[row]
            stay = least <= most.min(axis=1)[:, None]
            s = self.norm - self._dot(2 * (some << self.shift) + width)
            middle = s.argmin(axis=1)
            stay &= s - s.min(axis=1)[:, None] <= width * self.apart[middle]
            out += [np.flatnonzero(row).astype(np.uint16) for row in stay]
        self.filled += len(cells)
        return out

    def _dot(self, x: np.ndarray) -> np.ndarray:
        """Exact inner products with all entries; in doubles where they hold them."""
        if x.size and float(np.abs(x).max()) * float(np.abs(self.e).max()) * x.shape[1] < 2 ** 52:
            return (x.astype(np.float64) @ self.e.T.astype(np.float64)).astype(np.int64)
        return x @ self.e.T

    def _candidates(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The candidates of every distinct cell of ``x``, and each row's cell."""
        cells = np.ascontiguousarray((x >> self.shift).astype(np.int32))
        key = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, row = np.unique(key, return_index=True, return_inverse=True)
        names = [key[k].tobytes() for k in first]
        found = [self.cells.get(n) for n in names]
        new = [k for k, f in enumerate(found) if f is None]
        if len(self.cells) + len(new) > CACHE_CELLS:
            self.cells.clear()
        if new:
            for k, stay in zip(new, self._fill(cells[first[new]])):
                found[k] = self.cells[names[k]] = stay
        return found, row

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row of ``x``."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not len(x) or not x.shape[1]:
            return index, distance
        found, row = self._candidates(x)
        size = np.array([len(f) for f in found])
        begin, flat = np.cumsum(size) - size, np.concatenate(found).astype(np.int64)
        n = size[row]
        self.evaluated += int(n.sum())
        cuts = np.searchsorted(np.cumsum(n), np.arange(1 << 16, int(n.sum()) + (1 << 16), 1 << 16))
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(x))):
            if a >= b:
                continue
            m = n[a:b]
            at = np.cumsum(m) - m
            entry = flat[np.arange(int(m.sum())) + np.repeat(begin[row[a:b]] - at, m)]
            d = np.repeat(x[a:b], m, axis=0) - self.e[entry]
            d = np.einsum("ij,ij->i", d, d)
            distance[a:b] = np.minimum.reduceat(d, at)
            index[a:b] = np.minimum.reduceat(np.where(d == np.repeat(distance[a:b], m), entry, len(self.e)), at)
        return index, distance


def integer_rows(vectors: pa.Array, dim: int | None, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, length, codable) of a batch's rows as numpy; see the module's rules."""
    null = vectors.is_null().to_numpy(zero_copy_only=False)
    length = np.where(null, 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)           # nulls become NaN
    ends = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    kept = ~null & (bad[ends] == bad[ends - length])
    if dim is None:
        return kept, length, kept
    with np.errstate(invalid="ignore"):
        large = np.concatenate([[0], np.cumsum(~(np.abs(x) * SCALE < limit(dim, parts)))])
    return kept, length, kept & (length == dim) & (large[ends] == large[ends - length])


def to_integers(vectors: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    x = vectors.take(pa.array(np.flatnonzero(rows))).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * x).astype(np.int64).reshape(-1, dim)


def _start(most: int):
    """Of every length, the ``most`` smallest ids of a task with their vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict] = {}
        kind = vector_kind = None
        for batch in batches:
            kind, vector_kind = batch.schema.field("id").type, batch.schema.field("v").type
            kept, length, _ = integer_rows(batch.column("v"), None, 1)
            ids = batch.column("id").to_pylist()
            for n in np.unique(length[kept]).tolist():
                best = least.setdefault(n, {})
                here = [k for k in np.flatnonzero(kept & (length == n)).tolist() if ids[k] is not None]
                if not here:
                    continue
                edge = sorted({*best, *(ids[k] for k in here)})[:most][-1]
                for k in here:
                    if ids[k] <= edge:
                        v = batch.column("v")[k].as_py()
                        best[ids[k]] = min(v, best.get(ids[k], v))
                for i in sorted(best)[most:]:
                    del best[i]
        rows = [(n, i, v) for n, best in least.items() for i, v in best.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], vector_kind)], names=["n", "id", "v"])
    return run


def _sums(books: list[np.ndarray], dim: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, cut = [Grid(b) for b in books], bounds(dim, parts)
        total = [np.zeros((len(b), 1 + b.shape[1]), np.int64) for b in books]
        for batch in batches:
            _, _, rows = integer_rows(batch.column("v"), dim, parts)
            x = to_integers(batch.column("v"), rows, dim)
            for p, grid in enumerate(grids):
                part = x[:, cut[p]:cut[p + 1]]
                index, _ = grid.nearest(part)
                order = np.argsort(index, kind="stable")
                entry, at, count = np.unique(index[order], return_index=True, return_counts=True)
                if len(entry):
                    total[p][entry, 0] += count
                    if part.shape[1]:
                        total[p][entry, 1:] += np.add.reduceat(part[order], at, axis=0)
        for p, t in enumerate(total):
            entry, place = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                                              pa.array(t[entry, place], pa.int64())], names=["part", "entry", "place", "value"])
    return run


def _encode(books: list[np.ndarray], dim: int | None, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, cut = [Grid(b) for b in books], bounds(dim or 0, parts)
        for batch in batches:
            kept, _, rows = integer_rows(batch.column("v"), dim, parts)
            if dim is None:
                rows = np.zeros(len(kept), bool)
            x = to_integers(batch.column("v"), rows, dim) if dim is not None else np.zeros((0, 0), np.int64)
            found = [g.nearest(x[:, cut[p]:cut[p + 1]]) for p, g in enumerate(grids)]
            code, error = np.full(len(kept), None, object), np.zeros(len(kept), np.int64)
            if found:
                names = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                code[rows] = [r.tobytes().hex() for r in names]
                error[rows] = sum(d for _, d in found)
            at = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(code[kept], pa.string()),
                                              pa.array(error[kept], pa.int64(), mask=~rows[kept])], names=["id", "label", "code", "error"])
    return run


def start_books(d: DataFrame, scratch: Scratch, parts: int, entries: int) -> tuple[int | None, list[np.ndarray]]:
    """The length of vectors and the first codebooks."""
    kind, vector = d.schema["id"].dataType.simpleString(), d.schema["v"].dataType.simpleString()
    found = d.select("id", "v").mapInArrow(_start(entries), f"n int, id {kind}, v {vector}")
    found = scratch.keep(found.groupBy("n", "id").agg(F.min("v").alias("v")), "start")
    first = found.orderBy("id", "v").select("n").first()
    if first is None:
        return None, []
    dim = first["n"]
    rows = found.where(F.col("n") == dim).orderBy("id").limit(entries).select("v").collect()
    scratch.drop("start")
    v = pa.array([r["v"] for r in rows], pa.list_(pa.float64()))
    _, _, good = integer_rows(v, dim, parts)
    x, cut = to_integers(v, good, dim), bounds(dim, parts)
    if not len(x):
        return None, []
    return dim, [x[:, cut[p]:cut[p + 1]].copy() for p in range(parts)]


def moved(books: list[np.ndarray], rows) -> list[np.ndarray]:
    """Entries at the floored means of their parts; unused ones stay.
    ``rows``: (part, entry, place, value), place 0 the count."""
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        total.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["value"])
    out = [b.copy() for b in books]
    for (p, e), t in total.items():
        out[p][e] = [t.get(k + 1, 0) // t[0] for k in range(out[p].shape[1])]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector;
    ``entries`` is at most 256."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    dim, books = start_books(d, scratch, parts, entries)
    for _ in range(rounds if books else 0):
        sums = d.select("v").mapInArrow(_sums(books, dim, parts), "part int, entry int, place int, value long")
        books = moved(books, sums.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect())
    kinds = {c: d.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = scratch.keep(d.mapInArrow(_encode(books, dim, parts), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "coded")
    totals = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "totals")
    few = totals.count() <= SMALL_GROUPS
    out = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB: the same by plain search of all entries."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS (SELECT vec_id, label, part, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e), 'e': entry}}) AS best
        FROM parts JOIN c{r} USING (part) GROUP BY vec_id, label, part, x)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(v ORDER BY place) AS e FROM (
          SELECT part, best.e AS entry, place, floor(sum(v) / count(*)) AS v
          FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS (SELECT part, entry, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (part, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p AS part, x[len(x) * p // {PARTS} + 1:len(x) * (p + 1) // {PARTS}] AS x FROM v, range({PARTS}) t(p)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM parts
       QUALIFY entry < {ENTRIES}),{",".join(steps)},
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(e) AS v, generate_subscripts(e, 1) AS place FROM c{ROUNDS})),
o AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
      FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h
"""
