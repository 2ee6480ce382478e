"""Operator 4: n-gram Jaccard self-join by signature trees.

A document is the set of its distinct 5-word shingles (64-bit hashes of
lower-cased words); two sets link when their Jaccard similarity reaches the
threshold.  The result is exact up to hash collisions.

1. Sets.  One pass gives each row its set's size, a 64-bit fingerprint (copies
   share it and are one set from here on) and the set's prefix: the first
   n - ceil(t*n) + k shingles in one global order, with k about n/20.  Sets that
   link share k prefix shingles.  The order goes by the count in a bounded sample
   of documents, then by hash (any order is exact; this one keeps shared passages
   out of prefixes).
2. Blocks.  Sets that share fewer than k of their prefix shingles with any others,
   most of a corpus, end here.  The shingles of the others are counted exactly; by
   prefixes in the order from rare to frequent they hang on the smallest set of
   each prefix shingle, and the connected components of these stars are blocks.
3. Trees.  Blocks are dealt to tasks of bounded size; a block beyond the bound is
   cut by set size into chunks, the upper nodes of its tree; when the chunks are
   compared in themselves and with the block's least set, only sets that are not
   in the block's largest class meet the other chunks, if the size ranges can link.
   In a task the sets are the leaves of
   a signature tree; a node holds the OR of its sets' bitmaps, their size range
   and their largest excess (shingles beyond one per bit).  Two nodes can only
   hold linking sets if popcount(OR & OR) + excess reaches the least overlap that
   their sizes ask for; the dual traversal drops all other pairs of nodes, and
   pairs whose sets are connected already.  What is left is compared exactly.
4. Verified links, at most one per set and task beyond the first, are joined to
   components; copies come back by their fingerprint.

Defined results: null, empty and blank texts have size 0 and are alone; a text of
fewer words than a shingle is one shingle; repeated rows are copies; a null id is
carried, and is a component's id only if all its ids are null.  Extra columns are
ignored; an empty table gives an empty result.  Long texts take memory in
proportion to one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binary, fresh, likely_rows
from .components import components

WORDS = 5
SAMPLE_DOCS = 5_000         # documents (about) that tell common shingles from rare ones
COMMON_IN = 3               # sample documents that make a shingle common
MOST_COMMON = 400_000       # common shingles kept: 6.4 MB for each task
TASK_SHINGLES = 1_500_000   # shingles (about) of a chunk, and of the small blocks in a task
CACHE_WORDS = 150_000       # word hashes that a worker keeps


class WordHashes(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()          # bytes: only A-Z are lowered, only ASCII white space separates
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    k = min(words, len(w))
    if not k:
        return w
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i]
    return np.unique(_mix(h))


def _fingerprint(s: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _need(n, percent: int):
    """ceil(n * percent / 100)"""
    return (n * percent + 99) // 100


def _sets(common: Common, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                size, key, prefix = [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingles(text, words)
                    size.append(len(s))
                    key.append(_fingerprint(s) if len(s) else None)
                    prefix.append(_prefix(s, common, percent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(key, pa.int64()),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32),
                                              np.concatenate(prefix) if prefix else np.zeros(0, np.int64))],
                    names=["id", "h", "n", "s", "prefix"])
    return run


def _all_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words).view(np.int64))], names=["token"])
    return run


Common = tuple[np.ndarray, np.ndarray]          # sorted shingles and their counts in a sample


def common_shingles(texts: DataFrame, hash_col: str, n: int, words: int) -> Common:
    """Shingles that recur in a sample of about SAMPLE_DOCS of the ``n`` texts."""
    share = max(1, n // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.col(hash_col), F.lit(share)) == 0)
    counts = sample.select("text").mapInArrow(_all_shingles(words), "token long").groupBy("token").count() \
        .where(F.col("count") >= COMMON_IN)
    found = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    token = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r["count"] for r in found], np.int64)[order]


def _prefix(s: np.ndarray, common: Common, percent: int) -> np.ndarray:
    """The set's prefix in the global order: shingles that are not common by hash,
    then common ones from rare to frequent.  A passage that several groups of copies
    share is more frequent than the groups' own shingles, so it comes after them."""
    n = len(s)
    token, count = common
    if len(token) and n:
        where = np.minimum(np.searchsorted(token, s), len(token) - 1)
        s = s[np.argsort(np.where(token[where] == s, count[where], 0), kind="stable")]
    return (s[:n - _need(n, percent) + _shared(n)] if n else s).view(np.int64)


def _shared(n):
    """How many prefix shingles two linked sets of size n share at least."""
    return n // 20 + (n < 20)


def _candidates(posting: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(s): the sets that share enough prefix shingles with others to be linked.

    ``sizes`` (s, n).  A set's partner is no smaller than ``percent`` of it, so
    at least ``_shared`` of that size many of its prefix shingles are the partner's
    too.  Sets below that are dropped, then once more among those that stay."""
    least = F.ceil(F.col("n") * percent / 100)
    need = sizes.select("s", F.when(least < 20, 1).otherwise(F.floor(least / 20)).alias("need"))
    hits = posting
    for k in range(2):
        shared = scratch.keep(hits.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
                              .where("lo < hi").select("token"), f"shared-{k}")
        hits = scratch.keep(hits.join(shared, "token"), f"hits-{k}")
        scratch.free_shuffles()
        enough = scratch.keep(hits.groupBy("s").agg(F.count(F.lit(1)).alias("c")).join(need, "s").where("c >= need").select("s"), f"enough-{k}")
        hits = hits.join(enough, "s")
    scratch.drop("shared-0", "shared-1", "hits-0", "hits-1", "enough-0")
    return enough


def _set_tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column("s").take(pa.array(rows))], names=["token", "s"])
    return run


def _blocks(texts: DataFrame, sizes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(s, block) for the candidates' ``texts`` (s, text): components of sets that
    share a prefix shingle when shingles are ordered from rare to frequent, by exact
    counts among the candidates.  A set's own shingles come first and have no
    partner, so only what is left of the prefix is posted."""
    token = texts.mapInArrow(_set_tokens(words), "token long, s long")
    often = scratch.keep(token.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("s").alias("lo"), F.max("s").alias("hi"))
                         .where("lo < hi").select("token", "df"), "often")
    have = token.join(often, "token").join(sizes.select("s", "n"), "s")
    w = Window.partitionBy("s")
    have = have.withColumn("k", F.row_number().over(w.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(w))
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("m"))
    posted = scratch.keep(have.where(F.col("k") <= room).select("token", "s"), "posted")
    scratch.free_shuffles()
    stars = scratch.keep(posted.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi").select("token", "lo"), "stars")
    found = components(posted.join(stars, "token").where("s > lo").select(F.col("s").alias("a"), F.col("lo").alias("b")), scratch, "blocks")
    scratch.drop("often", "posted", "stars")
    return found.select(F.col("node").alias("s"), F.col("root").alias("block")) \
        .unionByName(found.select(F.col("root").alias("s"), F.col("root").alias("block")).distinct())


class SignatureTree:
    """Sets as leaves under nodes with OR bitmaps, size ranges and excess."""

    BITS, FAN = 2048, 8

    def __init__(self, sets: list[np.ndarray], block: np.ndarray):
        words = self.BITS // 64
        self.sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), words), np.uint64)
        for k, s in enumerate(sets):
            bit = (s >> np.uint64(50)) % np.uint64(self.BITS)
            np.bitwise_or.at(maps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        excess = self.sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        # level 0: the sets; each level above combines FAN neighbours
        self.levels = [(maps, self.sizes, self.sizes, excess, block, block)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex, b0, b1 = self.levels[-1]
            at = np.arange(0, len(m), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(ex, at), np.minimum.reduceat(b0, at), np.maximum.reduceat(b1, at)))

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """Nodes of the level below, -1 where there is none."""
        kids = node[:, None] * self.FAN + np.arange(self.FAN)
        kids[kids >= len(self.levels[level - 1][0])] = -1
        return kids


def _possible(a: SignatureTree, b: SignatureTree, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs whose largest possible overlap is enough for a link."""
    ma, loa, hia, exa, ba0, ba1 = a.levels[min(level, len(a.levels) - 1)]
    mb, lob, hib, exb, bb0, bb1 = b.levels[min(level, len(b.levels) - 1)]
    ok = (hia[i] * 100 >= lob[j] * percent) & (hib[j] * 100 >= loa[i] * percent) & (ba0[i] <= bb1[j]) & (bb0[j] <= ba1[i])
    i, j = i[ok], j[ok]
    # overlap * (100 + t) >= t * (|A| + |B|)
    bound = np.bitwise_count(ma[i] & mb[j]).sum(axis=1, dtype=np.int64) + np.minimum(exa[i], exb[j])
    ok[ok] = bound * (100 + percent) >= percent * (loa[i] + lob[j])
    return ok


class _Links:
    """Exact comparison of sets and the classes found so far in a task."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None):
        flat = np.concatenate(sets)
        _, dense = np.unique(flat, return_inverse=True)
        self.flat = dense.astype(np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(flat) else 1, bool)
        self.cls = np.arange(len(sets))
        if known is not None:
            _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
            self.cls = first[inverse]
        self.percent = percent

    def compare(self, i: int, js: np.ndarray) -> None:
        js = js[self.cls[js] != self.cls[i]]
        if not len(js):
            return
        own = self.flat[self.begin[i]:self.begin[i] + self.size[i]]
        self.mark[own] = True
        for at in range(0, len(js), 256):
            part = js[at:at + 256]
            n = self.size[part]
            ends = np.cumsum(n)
            where = np.arange(ends[-1]) + np.repeat(self.begin[part] - (ends - n), n)
            inter = np.add.reduceat(self.mark[self.flat[where]].astype(np.int64), ends - n)
            hit = part[inter * 100 >= self.percent * (n + self.size[i] - inter)]
            if len(hit):
                roots = np.unique(self.cls[np.append(hit, i)])
                self.cls[np.isin(self.cls, roots)] = roots[0]
        self.mark[own] = False


def link_sets(sets: list[np.ndarray], block: np.ndarray, side: np.ndarray | None, percent: int,
              known: np.ndarray | None = None) -> np.ndarray:
    """Class (an index) of every set: sets of one block that a chain of links
    joins.  With ``side`` only links between side 0 and side 1 are looked for;
    sets of one value of ``known`` are in one class from the start."""
    if not sets:
        return np.zeros(0, np.int64)
    links = _Links(sets, percent, known)
    every = np.arange(len(sets))
    mine, other = (every, every) if side is None else (every[side == 0], every[side == 1])
    if not len(mine) or not len(other):
        return links.cls
    a = SignatureTree([sets[k] for k in mine], block[mine])
    b = a if side is None else SignatureTree([sets[k] for k in other], block[other])
    top = max(len(a.levels), len(b.levels)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > 20_000:
            todo += [(level, i[k:k + 20_000], j[k:k + 20_000]) for k in range(0, len(i), 20_000)]
            continue
        ok = _possible(a, b, level, i, j, percent)
        i, j = i[ok], j[ok]
        if level:
            ci = a.children(level, i) if level < len(a.levels) else np.where(np.arange(a.FAN) == 0, i[:, None], -1)
            cj = b.children(level, j) if level < len(b.levels) else np.where(np.arange(b.FAN) == 0, j[:, None], -1)
            i, j = np.repeat(ci, b.FAN, axis=1).ravel(), np.tile(cj, a.FAN).ravel()
            real = (i >= 0) & (j >= 0)
            if a is b:
                real &= i <= j
            if level == 1 and a is b:
                real &= i != j
            i, j = i[real], j[real]
            if level == 1:
                far = links.cls[mine[i]] != links.cls[other[j]]
                i, j = i[far], j[far]
            if len(i):
                todo.append((level - 1, i, j))
        else:
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for k, js in zip(i[np.unique(i, return_index=True)[1]], np.split(j, np.unique(i, return_index=True)[1][1:])):
                links.compare(int(mine[k]), other[js])
    return links.cls


def _task(words: int, percent: int):
    def run(key, group):
        group = group.sort_by([("block", "ascending"), ("n", "ascending"), ("s", "ascending"), ("side", "ascending")])
        s, side = group.column("s").to_numpy(), group.column("side").to_numpy()
        new = np.append(True, (s[1:] != s[:-1]) | (side[1:] != side[:-1]))           # repeated rows are one set
        group = group.filter(pa.array(new))
        s, side, block = s[new], side[new], group.column("block").to_numpy()
        sets = [shingles(t, words) for t in group.column("text").to_pylist()]
        cls = link_sets(sets, block, side if side.max() else None, percent, group.column("known").to_numpy())
        linked = s != s[cls]
        return pa.table({"a": pa.array(s[linked], pa.int64()), "b": pa.array(s[cls[linked]], pa.int64())})
    return run


def _chunked(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Add ``chunk``: ranges of set sizes inside a block, of about TASK_SHINGLES
    shingles; sets of one size are spread over their places by hash."""
    w = Window.partitionBy("block").orderBy("n")
    hist = members.groupBy("block", "n").agg(F.count(F.lit(1)).alias("c")) \
        .select("block", "n", "c", (F.sum(F.col("c") * F.col("n")).over(w) - F.col("c") * F.col("n")).alias("before"))
    hist = scratch.keep(hist, f"{name}-places")
    place = F.col("before") + F.pmod(F.xxhash64("s"), F.col("c")) * F.col("n")
    return scratch.keep(members.join(hist, ["block", "n"]).withColumn("chunk", F.floor(place / TASK_SHINGLES)).drop("c", "before"), name)


def _nodes(chunks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The upper nodes of a block's tree: its chunks with their size ranges."""
    return scratch.keep(chunks.groupBy("block", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), name)


def _block_links(texts: DataFrame, members: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets that make all linked sets of a block one component.

    First every set is compared inside its chunk, to which the block's least set
    is added.  Mostly that connects all chunks.  Where it does not, the sets outside
    the block's largest class are compared with all chunks of the block.
    """
    sizes = scratch.keep(members.groupBy("block").agg(F.sum("n").alias("m")), "sizes")
    tasks = max(1, (sizes.agg(F.sum("m")).first()[0] or 0) // TASK_SHINGLES)
    small = members.join(sizes.where(F.col("m") <= TASK_SHINGLES).select("block"), "block") \
        .withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("string")))
    big = _chunked(members.join(sizes.where(F.col("m") > TASK_SHINGLES).select("block"), "block"), scratch, "chunks")
    nodes = _nodes(big, scratch, "nodes")

    def compare(placed: DataFrame, known: str, name: str) -> DataFrame:
        p = placed.select(F.col("s"), "block", "n", "task", "side", F.col(known).alias("known"))
        out = scratch.keep(texts.join(p, "s").select("task", "s", "block", "n", "side", "known", "text").groupBy("task")
                           .applyInArrow(_task(words, percent), "a long, b long"), name)
        scratch.free_shuffles()
        return out

    task = F.concat_ws("-", F.lit("b"), "block", "chunk")
    least = big.where("s = block").drop("chunk").join(nodes.select("block", "chunk"), "block")
    first = small.unionByName(big.unionByName(least).distinct().withColumn("task", task).drop("chunk")).withColumn("side", F.lit(0))
    edges = compare(first, "s", "links-1")
    if not nodes.head(1):
        return edges
    roots = components(edges, scratch, "first").withColumnRenamed("node", "s")
    big = scratch.keep(big.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "classes-1")
    largest = big.groupBy("block", "root").agg(F.sum("n").alias("w")).groupBy("block").agg(F.max(F.struct("w", "root")).alias("x")) \
        .select("block", F.col("x.root").alias("largest"))
    rest = scratch.keep(big.join(largest, "block").where("root <> largest").drop("largest", "chunk"), "rest")
    if not rest.head(1):
        return edges
    rest = _chunked(rest, scratch, "rest-chunks")
    x, y = nodes.alias("x"), _nodes(rest, scratch, "rest-nodes").alias("y")
    pairs = scratch.keep(x.join(y, "block").where(f"x.lo * {percent} <= y.hi * 100 AND y.lo * {percent} <= x.hi * 100").select(
        "block", F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b"),
        F.concat_ws("-", F.lit("r"), "block", "x.chunk", "y.chunk").alias("task")), "pairs")
    again = big.join(pairs.select("block", F.col("a").alias("chunk"), "task"), ["block", "chunk"]).withColumn("side", F.lit(0)) \
        .unionByName(rest.join(pairs.select("block", F.col("b").alias("chunk"), "task"), ["block", "chunk"]).withColumn("side", F.lit(1)))
    return edges.unionByName(compare(again, "root", "links-2"))


def jaccard_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 percent: int = 80, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows are (id, h, n, s) with h the text's hash and s the
    set's fingerprint (null without words); classes are (s, component: the least
    id, least_id and least_h: the first row) for every set."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), binary(text_col).alias("text"))
    n_docs = docs.select(F.lit(1)).count()
    common = common_shingles(d, "h", n_docs, words)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.keep(d.mapInArrow(_sets(common, words, percent), f"id {kind}, h long, n long, s long, prefix array<long>"), "sets")
    known = rows.where("s IS NOT NULL")
    # one row of each set: its least (id, h); and the sets of blocks
    one = scratch.keep(known.groupBy("s").agg(F.min("n").alias("n"), F.min(F.struct("id", "h")).alias("first"))
                       .select("s", "n", "first.id", "first.h"), "one")
    posting = known.select("s", F.explode("prefix").alias("token")).select("token", "s")
    chosen = scratch.keep(one.join(_candidates(posting, one.select("s", "n"), scratch, percent), "s"), "chosen")
    firsts = chosen.select("s", F.col("id").alias("mid"), F.col("h").alias("mh"))
    theirs = likely_rows(d, F.xxhash64("id", "h"), firsts, F.xxhash64("mid", "mh"), chosen.count())     # few other texts are shuffled
    texts = scratch.keep(theirs.join(firsts, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")))
                         .select("s", "text").dropDuplicates(["s"]), "texts")
    scratch.free_shuffles()
    members = scratch.keep(chosen.join(_blocks(texts, chosen, scratch, words, percent), "s"), "members")
    found = components(_block_links(texts, members.select("s", "n", "block"), scratch, words, percent), scratch, "links")
    scratch.drop("texts")

    classes = one.join(found.select(F.col("node").alias("s"), "root"), "s", "left") \
        .select("s", "id", "h", F.coalesce("root", "s").alias("root"))
    classes = scratch.keep(classes, "classes")
    best = scratch.keep(classes.groupBy("root").agg(F.min("id").alias("component"), F.min(
        F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("f")).select("root", "component", "f.id", "f.h"), "best")
    return rows.select("id", "h", "n", "s"), scratch.keep(classes.select("s", "root").join(best, "root").select(
        "s", "component", F.col("id").alias("least_id"), F.col("h").alias("least_h")), "mapped")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per document."""
    rows, classes = jaccard_sets(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    return rows.join(classes, "s", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     percent: int = 80) -> DataFrame:
    """The documents, with one (the least id) of each component; its columns are
    those of ``docs``.  Documents without words are in no group and stay."""
    rows, classes = jaccard_sets(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    out = rows.join(classes, "s", "left").where(
        "s IS NULL OR (id <=> least_id AND h = least_h)").select("id", "h", "s").distinct()
    i, h, s, k = fresh(docs, "_i", "_h", "_s", "_k")
    stay = out.select(F.col("id").alias(i), F.col("h").alias(h), F.col("s").alias(s))
    d = docs.withColumn(k, F.xxhash64(text_col))
    d = d.join(stay, d[id_col].eqNullSafe(stay[i]) & (d[k] == stay[h]))
    alone = d.where(F.col(s).isNull())
    return alone.unionByName(d.where(F.col(s).isNotNull()).dropDuplicates([s])).drop(i, h, s, k)
