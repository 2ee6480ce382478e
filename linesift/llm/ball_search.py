"""Operator 12: ranked lexical search by exact maximum-inner-product ball trees.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII; A-Z are lowered.  A document is a sparse vector of integer impacts
w * ((10**9 * tf) div (1000 * tf + 12 * m)) over the terms of the items, an item the
vector of its term counts, a score their inner product.

1. Items are taken in blocks of about ``BLOCK_ITEMS``; a block's distinct terms are its
   vocabulary.  One pass over the documents writes each one's length and its counts of
   these terms; the corpus counts N, L and df are sums over that table.
2. The scores of a sample of about ``SEED_DOCS`` documents give each item a score that
   its last result reaches at least: where the other documents' search starts.
3. The items are themselves the leaves of a ball tree whose leaves of at most
   ``GROUP_ITEMS`` similar items form groups.  A task builds a ball tree over each chunk of
   its documents for each group, over the group's terms only: what else a document says
   does not widen its ball.  A node holds a sparse centroid and the largest distance of its
   documents from it; no document below it scores above item . centroid + |item| * radius.
   Each item opens nodes best-first and stops where the bound falls below its k-th score.
   Bounds are rounded up by more than their arithmetic can err, scores at leaves are exact
   integers, so the result is exact.
4. Each task returns at most k rows of an item; they are ranked in Spark.

Defined results: null and empty texts have no terms; documents without terms count
neither in N nor in L and are never returned, items without terms get no rows.
Equal scores go by ascending document id, nulls last.  Repeated document rows are
ranked each; items equal in id and text are one item, items that share only an id
are ranked each on its own.  Extra columns are ignored; an empty table gives an empty
result.  Long texts take memory in proportion to one text.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TERM_BYTES, Scratch, binary

TOP = 20
BLOCK_ITEMS = 2_000
SEED_DOCS = 20_000              # documents (about) that give the first thresholds
CHUNK_DOCS, CHUNK_COUNTS = 16_384, 4_000_000
LEAF = 32
GROUP_ITEMS = 16
SAFE = 2.0 ** -30               # relative; sums of up to 10**6 doubles err by far less


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Items:
    """Items as sparse count vectors (term, count) over ``n_terms`` terms."""

    def __init__(self, of: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.of, self.n_terms = of, n_terms
        self.norm = np.array([math.sqrt(float((n.astype(np.float64) ** 2).sum())) for _, n in of])
        # postings: items of each term
        item = np.repeat(np.arange(len(of)), [len(t) for t, _ in of])
        term, count = (np.concatenate([x[k] for x in of]) if of else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(term, kind="stable")
        self.item, self.count = item[order], count[order].astype(np.float64)
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def dot(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every item's inner product with a sparse vector of doubles."""
        n = self.first[term + 1] - self.first[term]
        where = np.arange(int(n.sum())) + np.repeat(self.first[term] - (np.cumsum(n) - n), n)
        return np.bincount(self.item[where], self.count[where] * np.repeat(value, n), len(self.of))


class Block:
    """A block's vocabulary, and its items in groups of similar ones: (places in the
    block, the group's term of each term of the vocabulary or -1, items)."""

    def __init__(self, texts: list[bytes], group: int = GROUP_ITEMS):
        counts = [Counter(terms(t)) for t in texts]
        self.n_items, self.vocabulary = len(texts), {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        of = [(np.array([self.vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        asked = [k for k, (t, _) in enumerate(of) if len(t)]
        self.groups: list[tuple[list[int], np.ndarray, Items]] = []
        if not asked:
            return
        tree = BallTree(np.cumsum([0, *(len(of[k][0]) for k in asked)]), np.concatenate([of[k][0] for k in asked]),
                        np.concatenate([of[k][1] for k in asked]), len(self.vocabulary), group)
        for lo, hi in sorted((lo, hi) for lo, hi, left in zip(tree.lo, tree.hi, tree.left) if left < 0):
            for at in range(lo, hi, group):                                      # a leaf of equal items may be larger
                places = [asked[k] for k in tree.order[at:min(hi, at + group)]]
                used = np.unique(np.concatenate([of[k][0] for k in places]))
                within = np.full(len(self.vocabulary), -1)
                within[used] = np.arange(len(used))
                self.groups.append((places, within, Items([(within[of[k][0]], of[k][1]) for k in places], len(used))))


class BallTree:
    """Sparse integer vectors (rows of ptr, term, value) under balls."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, leaf: int = LEAF):
        self.ptr, self.term, self.value, self.n_terms = ptr, term, value, n_terms
        self.real = value.astype(np.float64)
        self.square = np.add.reduceat(self.real * self.real, ptr[:-1]) if len(ptr) > 1 else np.zeros(0)
        self.order = np.arange(len(ptr) - 1)
        self.lo, self.hi, self.left, self.centre, self.radius = [], [], [], [], []
        todo = [self._node(0, len(self.order))] if len(self.order) else []
        while todo:
            k, away = todo.pop()
            lo, hi = self.lo[k], self.hi[k]
            if hi - lo <= leaf or self.radius[k] ** 2 <= 16 * SAFE * self.square[self.order[lo:hi]].max():
                continue
            self._split(lo, hi, away)
            self.left[k] = len(self.lo)
            todo += [self._node(lo, (lo + hi) // 2), self._node((lo + hi) // 2, hi)]
        # a leaf's rows side by side
        where, at = self._places(self.order)
        self.ptr = np.append(at, len(where))
        self.term, self.value = self.term[where], self.value[where]
        self.bound: dict[int, np.ndarray] = {}
        self.scored = 0

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.ptr[rows + 1] - self.ptr[rows]
        at = np.cumsum(n) - n
        return np.arange(int(n.sum())) + np.repeat(self.ptr[rows] - at, n), at

    def _times(self, dense: np.ndarray, where: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.real[where] * dense[self.term[where]], at)

    def _node(self, lo: int, hi: int) -> tuple[int, np.ndarray]:
        """Add the ball of rows lo to hi; also their squared distances from its centre."""
        rows = self.order[lo:hi]
        where, at = self._places(rows)
        centre = np.bincount(self.term[where], self.real[where], self.n_terms) / (hi - lo)
        used = np.flatnonzero(centre)
        size = float((centre[used] ** 2).sum())
        away = self.square[rows] - 2 * self._times(centre, where, at) + size
        self.lo.append(lo)
        self.hi.append(hi)
        self.left.append(-1)
        self.centre.append((used, centre[used]))
        self.radius.append(math.sqrt(float((np.maximum(away, 0) + SAFE * (self.square[rows] + size)).max())))
        return len(self.lo) - 1, away

    def _split(self, lo: int, hi: int, away: np.ndarray) -> None:
        """Halve the rows along the line between two far ones."""
        rows = self.order[lo:hi]
        where, at = self._places(rows)

        def dense(row: int) -> np.ndarray:
            x = np.zeros(self.n_terms)
            s = slice(self.ptr[row], self.ptr[row + 1])
            x[self.term[s]] = self.real[s]
            return x

        a = dense(rows[int(away.argmax())])
        with_a = self._times(a, where, at)
        b = dense(rows[int((self.square[rows] - 2 * with_a).argmax())])
        along = self._times(b, where, at) - with_a
        self.order[lo:hi] = rows[np.argpartition(along, (hi - lo) // 2)]

    def _bound(self, node: int, items: Items) -> np.ndarray:
        if node not in self.bound:
            self.bound[node] = (items.dot(*self.centre[node]) + items.norm * self.radius[node]) * (1 + SAFE) + 1
        return self.bound[node]

    def search(self, items: Items, q: int, least: int, k: int, dense: np.ndarray) -> list[tuple[int, int]]:
        """(score, row) of all rows that may be among the item's k best with a score
        of at least ``least``.  ``dense``: integer zeros of vocabulary size."""
        if not self.lo or not len(items.of[q][0]):
            return []
        term, count = items.of[q]
        dense[term] = count
        out, best = [], []                        # best: the k highest scores so far
        heap = [(-self._bound(0, items)[q], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    b = self._bound(child, items)[q]
                    if b >= least:
                        heapq.heappush(heap, (-b, child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            s = slice(self.ptr[lo], self.ptr[hi])
            score = np.add.reduceat(self.value[s] * dense[self.term[s]], self.ptr[lo:hi] - self.ptr[lo])
            self.scored += hi - lo
            for r in np.flatnonzero(score >= least).tolist():
                x = int(score[r])
                out.append((x, int(self.order[lo + r])))
                heapq.heappush(best, x)
                if len(best) > k:
                    heapq.heappop(best)
            if len(best) == k:
                least = max(least, best[0])
        dense[term] = 0
        return [x for x in out if x[0] >= least]


def _vectors(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                length, term, tf = [], [], []
                for text in batch.column("text").to_pylist():
                    words = terms(text)
                    known = [x for x in map(get, words) if x is not None]
                    t, n = np.unique(np.array(known, np.int32), return_counts=True)
                    length.append(len(words))
                    term.append(t)
                    tf.append(n.astype(np.int32))
                ends = np.concatenate([[0], np.cumsum([len(t) for t in term])]).astype(np.int32)
                flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(length, pa.int64()), pa.ListArray.from_arrays(ends, flat[0]),
                                                  pa.ListArray.from_arrays(ends, flat[1])], names=["id", "n", "term", "tf"])
    return run


def _document_counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("term").flatten().to_numpy(), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], names=["term", "df"])
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of terms of weight ``w`` that stand ``tf`` times in a document of length ``n``."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _order(found: tuple[int, object]) -> tuple:
    score, doc = found
    return -score, doc is None, doc if doc is not None else 0


def _search(sent, w: np.ndarray, n_docs: int, total: int, least: np.ndarray, k: int):
    """Rows (q, id, score): a task's k best documents of every item."""
    def chunks(batches):
        held, docs, counts = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                held.append(part)
                docs, counts = docs + part.num_rows, counts + len(part.column("term").flatten())
                if docs >= CHUNK_DOCS or counts >= CHUNK_COUNTS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, docs, counts = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = sent.value, None
        best: list[list[tuple[int, object]]] = [[] for _ in range(block.n_items)]
        floor = least.copy()
        for table in chunks(batches):
            kind = table.schema.field("id").type
            ids = table.column("id").chunk(0)
            size = table.column("term").chunk(0).value_lengths().to_numpy()
            term = table.column("term").chunk(0).flatten().to_numpy().astype(np.int64)
            tf = table.column("tf").chunk(0).flatten().to_numpy().astype(np.int64)
            value = impacts(w[term], tf, np.repeat(table.column("n").to_numpy(), size), n_docs, total)
            row = np.repeat(np.arange(len(size)), size)
            for places, within, items in block.groups:
                own = within[term]
                used = np.flatnonzero((own >= 0) & (value > 0))
                rows, at = np.unique(row[used], return_index=True)
                if not len(rows):
                    continue
                tree, dense = BallTree(np.append(at, len(used)), own[used], value[used], items.n_terms), np.zeros(items.n_terms, np.int64)
                for j, q in enumerate(places):
                    found = tree.search(items, j, int(floor[q]), k, dense)
                    if found:
                        named = ids.take(pa.array(rows[[r for _, r in found]])).to_pylist()
                        best[q] = sorted([*best[q], *((s, i) for (s, _), i in zip(found, named))], key=_order)[:k]
                        if len(best[q]) == k:
                            floor[q] = max(floor[q], best[q][-1][0])
        flat = [(q, i, s) for q, b in enumerate(best) for s, i in b]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], kind),
                                              pa.array([x[2] for x in flat], pa.int64())], names=["q", "id", "score"])
    return run


def _block(d: DataFrame, texts: list[bytes], k: int, scratch: Scratch, name: str) -> DataFrame | None:
    """(q, id, score, rank) of a block's items."""
    spark = d.sparkSession
    block = Block(texts)
    if not block.groups:
        return None
    kind = d.schema["id"].dataType.simpleString()
    words = spark.sparkContext.broadcast(block.vocabulary)
    vectors = scratch.keep(d.mapInArrow(_vectors(words), f"id {kind}, n long, term array<int>, tf array<int>").where("n > 0"), f"{name}-vectors")
    words.destroy()
    n_docs, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.zeros(len(block.vocabulary), np.int64)
    for r in vectors.select("term").mapInArrow(_document_counts(len(w)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        w[r["term"]] = weight(n_docs, r["df"])          # at most a row for each term of the block
    sent = spark.sparkContext.broadcast(block)
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())

    def best(of: DataFrame, least: np.ndarray) -> DataFrame:
        found = of.mapInArrow(_search(sent, w, n_docs, total, least, k), f"q int, id {kind}, score long")
        return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    least = np.ones(block.n_items, np.int64)
    if n_docs > SEED_DOCS:
        sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(n_docs // SEED_DOCS)) == 0)
        for r in best(sample, least).where(F.col("rank") == k).collect():           # at most a row for each item of the block
            least[r["q"]] = max(1, r["score"])
    out = scratch.keep(best(vectors, least), f"{name}-found")
    sent.destroy()
    scratch.drop(f"{name}-vectors")
    return out


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item id, rank, document id, score): each item's ``k`` best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    d = docs.select(F.col(id_col).alias("id"), binary(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    asked = scratch.keep(asked, "items")
    blocks = max(1, -(-asked.count() // block_items))
    kinds = asked.schema["item"].dataType, d.schema["id"].dataType
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()     # about block_items
        out = _block(d, [r["text"].encode() for r in rows], k, scratch, f"b{b}")
        if out is not None:
            names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"q int, item {kinds[0].simpleString()}")
            found.append(out.join(F.broadcast(names), "q").select("item", "rank", "id", "score"))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame(
        [], f"item {kinds[0].simpleString()}, rank int, id {kinds[1].simpleString()}, score long")
    return out.select(F.col("item").alias(item_id_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
word AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM len),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM item GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
           FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
