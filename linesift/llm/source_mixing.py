"""Operator 7: mixing sources to target weights by a splitting tree.

1. Targets.  Sources, by code point (null last), share ``share`` times all words
   in proportion to their weights; a source stops at ``most`` times its words and
   the excess is shared again by weight (water filling over one row per source).
2. Blocks.  Each source's documents are put in random order by a seeded hash and
   cut into blocks of that order.  A target of 1.4 times the source's words takes
   every block once, and of a second permuted round the first blocks up to the
   target; in the last, cut block documents are taken in order until the next one
   would move the total away from the target.
3. Dealing.  The blocks that each source gives are exact quotas.  A binary tree
   over the output shards splits them: a node draws how many blocks of each
   source go left from the multivariate hypergeometric distribution, seeded by
   the node, so the draw is the same on every run and needs no data.  Shards then
   take disjoint runs of each source's permuted blocks.  The upper ``TOP_NODES``
   nodes are split on the driver, each one's subtree in a task of its own, together
   with the blocks that it deals; a document gets the shards of its block.
4. ``draw`` repeats the documents as often as they are taken, by shard, and
   shuffles each shard locally.

The driver sees one row per source and upper node.  Everything by document is hashing, sums by
block (partial aggregation) and a join with the per-source row; the running sum
inside a source goes over its blocks, whose number is at most the root of its
documents beyond the first ones.

Defined results: a null text has no words; the null source is a source of its
own, the last; rows equal in id, text and source are taken alike or, at the cut, one
for the other; rows equal in id and text alone are taken by each source as its own; a
source without words takes nothing; extra columns are ignored, and kept by ``draw``;
an empty table gives an empty result.  Long texts take memory in proportion to one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, row_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK_DOCS = 256            # documents of a block, or the root of the source's documents
SHARD_WORDS = 4_000_000     # words of an output shard (about)
SMALL_SOURCES = 10_000      # up to so many sources the per-source rows are broadcast
TOP_NODES = 1024            # nodes of the tree (about) that the driver splits
MOST_PARTITIONS = 100_000   # of the mix that is drawn


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Water filling: weights' shares of ``share * sum(sizes)``, none above ``most * size``."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = sorted(range(len(sizes)), key=lambda k: most * sizes[k] / weights[k])
    weight = sum(weights)
    for k in open_:                      # the source that fills up first comes first
        fair = total * weights[k] / weight if weight > 0 else 0.0
        out[k] = min(most * sizes[k], fair)
        total -= out[k]
        weight -= weights[k]
    return out


Node = tuple[int, int, np.ndarray]               # first shard, end, blocks of each source


def split_tree(node: Node, seed: int, width: int = 1) -> list[Node]:
    """The node's descendants of at most ``width`` shards, in order."""
    todo, out = [node], []
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo <= width:
            out.append((lo, hi, have))
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        go = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, go, method="marginals") if total else have
        todo += [(mid, hi, have - left), (lo, mid, left)]
    return out


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets."""
    return np.array([have for _, _, have in split_tree((0, shards, blocks), seed)])


def _deal(seed: int):
    """Shards of the blocks (k, g: place in the node's run) of one upper node."""
    def run(group: pa.Table) -> pa.Table:
        lo, hi, have = (group.column(c)[0].as_py() for c in ("lo", "hi", "have"))
        parts = split_tree((lo, hi, np.array(have, np.int64)), seed)
        ends = np.cumsum([h for _, _, h in parts], axis=0)
        k, g = group.column("k").to_numpy(), group.column("g").to_numpy()
        shard = np.zeros(len(k), np.int64)
        for one in np.unique(k):
            shard[k == one] = lo + np.searchsorted(ends[:, one], g[k == one], side="right")
        return pa.table({"k": k, "block": group.column("block"), "nth": group.column("nth"), "shard": pa.array(shard, pa.int32())})
    return run


def _dealt(places: DataFrame, quota: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(k, block, shards: of its rounds in order) for ``places`` (k, block, nth, place:
    in the source's run of blocks)."""
    spark = places.sparkSession
    nodes = split_tree((0, shards, quota), seed, -(-shards // TOP_NODES))
    ends = np.cumsum([have for _, _, have in nodes], axis=0)
    runs = spark.createDataFrame([(k, ends[:, k].tolist()) for k in range(len(quota))], "k int, ends array<long>")
    upper = spark.createDataFrame([(n, lo, hi, have.tolist(), (ends[n] - have).tolist()) for n, (lo, hi, have) in enumerate(nodes)],
                                  "node int, lo int, hi int, have array<long>, first array<long>")
    d = places.join(F.broadcast(runs), "k").withColumn("node", F.expr("size(filter(ends, x -> x <= place))")).drop("ends")
    d = d.join(F.broadcast(upper), "node").withColumn("g", F.col("place") - F.element_at("first", F.col("k") + 1))
    d = d.select("node", "lo", "hi", "have", "k", "block", "nth", "g").groupBy("node").applyInArrow(_deal(seed), "k int, block int, nth int, shard int")
    return d.groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("nth", "shard")))["shard"].alias("dealt"))      # a row a round


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS,
                seed: str = "mix-1", scratch: Scratch | None = None) -> DataFrame:
    """(id, key, source, size, source_size, target, copies, taken, shards) per row of ``docs``.

    ``key`` is the row's md5 key (``common.row_key``), ``copies`` how often the mix
    takes it, ``shards`` the shard of each copy.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_key(id_col, text_col).alias("key"),
                                    size.alias("size"))
                        .withColumn("place", F.md5(F.concat("key", F.lit(seed)))), "rows")
    found = sorted(((r["source"], r["words"], r["n"]) for r in rows.groupBy("source").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()),
        key=lambda r: (r[0] is None, (r[0] or "").encode()))               # one row per source
    wanted = targets([float(w) for _, w, _ in found], [weights[k % len(weights)] for k in range(len(found))], share, most)
    plan = []
    for k, ((source, words, n), target) in enumerate(zip(found, wanted)):
        whole = int(target // words) if words else 0
        blocks = max(1, math.floor(n / max(BLOCK_DOCS, n ** 0.5) + 0.5))
        plan.append((k, source, words, target, whole, target - whole * words, blocks))
    schema = "k int, source string, words long, target double, whole int, rest double, blocks int"
    per_source = spark.createDataFrame(plan, schema)
    small = F.broadcast if len(plan) <= SMALL_SOURCES else (lambda df: df)

    # blocks are runs of the source's random order
    r = rows.alias("r").join(small(per_source).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))) \
        .select("id", "key", "r.source", "size", "place", "p.k", "words", "target", "whole", "rest", "blocks")
    spot = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    r = r.withColumn("block", F.floor(spot * F.col("blocks")).cast("int"))
    sums = r.groupBy("k", "block").agg(F.sum("size").alias("in_block"), F.max("rest").alias("rest"))
    w = Window.partitionBy("k").orderBy("block")
    sums = scratch.keep(sums.select("k", "block", "rest", (F.sum("in_block").over(w) - F.col("in_block")).alias("before"),
                                    F.sum("in_block").over(w).alias("after")), "blocks")
    state = F.when(F.col("after") <= F.col("rest"), F.lit(1)).when(F.col("before") < F.col("rest"), F.lit(0)).otherwise(F.lit(-1))
    sums = sums.withColumn("state", state)          # 1: taken whole, 0: cut, -1: not taken
    r = r.join(sums.select("k", "block", "before", "state"), ["k", "block"])
    run = Window.partitionBy("k", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = r.where("state = 0").withColumn("_upto", F.col("before") + F.sum("size").over(run)) \
        .withColumn("extra", (F.col("_upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("_upto")
    r = cut.unionByName(r.where("state <> 0").withColumn("extra", (F.col("state") == 1).cast("int")))

    # the tree deals what each source gives: all blocks in every whole round, the first ones of the last round
    last = {x["k"]: x["n"] for x in sums.where("state >= 0 AND rest > 0").groupBy("k").agg((F.max("block") + 1).alias("n")).collect()}
    quota = np.array([whole * blocks + last.get(k, 0) for k, _, _, _, whole, _, blocks in plan], np.int64)
    r = r.withColumn("copies", F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
    if quota.sum():
        rounds = small(per_source.select("k", "whole", "blocks"))
        places = sums.join(rounds, "k").withColumn("rounds", F.col("whole") + F.when((F.col("state") >= 0) & (F.col("rest") > 0), 1).otherwise(0)) \
            .where("rounds > 0").select("k", "block", "blocks", F.explode(F.expr("sequence(0, rounds - 1)")).alias("nth"))
        places = places.select("k", "block", "nth", (F.col("nth").cast("long") * F.col("blocks") + F.col("block")).alias("place"))
        shards = max(1, math.ceil(sum(wanted) / shard_words))
        r = r.join(scratch.keep(_dealt(places, quota, shards, zlib.crc32(seed.encode())), "dealt"), ["k", "block"], "left")
    else:
        r = r.withColumn("dealt", F.array().cast("array<int>"))
    return r.select("id", "key", "source", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
                    F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), F.col("copies")).alias("shards"))


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix-1", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken,
    one shard after the other and in random order inside each shard."""
    source = options.get("source_col", "source")
    scratch = options.setdefault("scratch", Scratch(docs.sparkSession, "draw"))
    m = mix_sources(docs, id_col=id_col, text_col=text_col, seed=seed, **options)
    key, mine, shard, nth = fresh(docs, "_key", "_mine", "_shard", "_nth")

    def own(row: Column, of: str) -> Column:                     # one column: rows of one key meet once and are joined where they are
        return F.md5(F.concat(row, F.when(F.col(of).isNull(), F.lit("|")).otherwise(F.concat(F.lit(":"), F.col(of)))))

    copies = scratch.keep(m.where("copies > 0").select(own(F.col("key"), "source").alias(mine), F.posexplode("shards").alias(nth, shard)), "copies")
    shards = copies.agg(F.max(shard)).first()[0] or 0
    one = docs.withColumn(key, own(row_key(id_col, text_col), source)).dropDuplicates([key])      # rows of one key are one document
    out = one.join(copies, F.col(key) == F.col(mine))
    return out.repartition(min(shards + 1, MOST_PARTITIONS), shard) \
        .sortWithinPartitions(shard, F.md5(F.concat(key, F.col(nth).cast("string"), F.lit(seed)))).select(*[out[c] for c in docs.columns])
