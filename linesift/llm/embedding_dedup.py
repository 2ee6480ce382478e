"""Operator 2: near-duplicate vectors by a random-projection tree forest.

1. Copies (equal label and components) become one node with a count.
2. Every node is projected on random directions, one per tree and level.  Level by
   level a group (label, dimension, tree, path) with more than ``leaf`` nodes is
   cut at its median; nodes within a margin of the cut go to both sides (spill).
   The margin follows the largest distance of a linked pair and the group's own
   density at the median: it is the least at which a pair at the threshold is
   parted with a chance of at most ``CHANCE``, so a group whose vectors share a
   direction gets a margin wide against its spread.  The number of trees follows
   the number of levels: all of them together part such a pair with a chance of
   at most ``MISS``.  A group that a cut would hardly shrink, such as one dense
   cluster or a label of much alike vectors, is left whole and tried again in the
   next direction; a label that some tree leaves whole is compared in that tree
   alone, exactly.  A level is one aggregation (medians are mergeable) and one
   join with the table of cuts.
3. Leaves are compared all against all, in double precision.  A leaf beyond
   ``leaf`` nodes, a large cluster, is dealt in chunks and compared pair of chunks
   by pair of chunks, so a task stays bounded.  A pair may share several leaves:
   each node knows its leaves, and only the pair's least common leaf counts it.
   A task returns one row per linked node (links, least node it reaches), never
   the pairs.
4. The rows' sums are the link counts; the components of the (node, least node)
   edges are the groups.

Defined results: a vector that is null, empty, zero or has null, NaN or infinite
components, and a null label, links with nothing; vectors of different length do
not link; repeated rows link like copies; a null id is never a group's id unless
all are.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

TREES = 8                   # at least
LEAF = 512
MOST_LEVELS = 32
SPILL = 0.4                 # least margin of a cut, in typical projected distances of the farthest linked pair
CHANCE = 0.04               # a cut parts a pair at the threshold at most this often
MISS = 0.005                # all trees together do so at most this often
SHRINK = 0.65               # a cut must leave at most this share on either side


def beyond(u: float) -> float:
    """E max(0, |z| - u) of a standard normal z: by how much a pair's projected distance exceeds both margins."""
    return 2 * (math.exp(-u * u / 2) / math.sqrt(2 * math.pi) - u * math.erfc(u / math.sqrt(2)) / 2)


# margins in projected distances, and the length beyond both sides that is parted
MARGINS = [(m / 100, beyond(m / 50)) for m in range(round(100 * SPILL), 201, 2)]


def trees_for(levels: int, least: int = TREES) -> int:
    """Trees that together part a pair at most with chance ``MISS``, if each cuts ``levels`` times."""
    parted = 1 - (1 - CHANCE) ** levels
    return max(least, math.ceil(math.log(MISS) / math.log(parted))) if levels else 1


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _project(trees: int, levels: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                dim = int(dim)
                part = batch.filter(pa.array(dims == dim))
                if dim not in directions:
                    d = np.random.default_rng([seed, dim]).standard_normal((dim, trees * levels))
                    directions[dim] = d / np.sqrt((d * d).sum(axis=0))
                p = (unit(_matrix(part.column("v"), dim)) @ directions[dim]).astype(np.float32)
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(np.repeat(np.arange(n), trees))) for c in ("node", "label", "dim")]
                    + [pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                       pa.ListArray.from_arrays(np.arange(0, n * trees * levels + 1, levels, dtype=np.int32), p.ravel())],
                    names=["node", "label", "dim", "tree", "p"])
    return run


def _earlier(codes: list[np.ndarray], mine: int) -> np.ndarray:
    """Boolean matrix: which nodes share a leaf that counts before this one."""
    n = len(codes)
    rows = np.repeat(np.arange(n), [len(c) for c in codes])
    flat = np.concatenate(codes)
    low = flat < mine
    rows, flat = rows[low], flat[low]
    known, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[column] > 1
    rows, column = rows[often], column[often]
    if not len(rows):
        return np.zeros((n, n), bool)
    used, column = np.unique(column, return_inverse=True)
    hot = np.zeros((n, len(used)), np.float32)
    hot[rows, column] = 1
    return hot @ hot.T > 0


def _compare(threshold: float):
    def run(key, group):
        leaf, a, b = key[0].as_py(), key[1].as_py(), key[2].as_py()
        node, weight = group.column("node").to_numpy(), group.column("m").to_numpy()
        dim = group.column("dim")[0].as_py()
        x = unit(_matrix(group.column("v"), dim))
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        if a != b:                          # only pairs across the two chunks
            chunk = group.column("chunk").to_numpy()
            hit &= chunk[:, None] != chunk[None, :]
        linked = np.flatnonzero(hit.any(axis=1))
        if not len(linked):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        hit = hit[np.ix_(linked, linked)]
        codes = [np.array(c, np.int64) for c in group.column("codes").take(pa.array(linked)).to_pylist()]
        first = hit & ~_earlier(codes, leaf)
        links = first @ weight[linked]
        root = node[linked].copy()
        while True:                         # least node that a chain of links inside the task reaches
            low = np.minimum(root, np.where(hit, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (low == root).all():
                break
            root = low
        return pa.table({"node": pa.array(node[linked]), "links": pa.array(links.astype(np.int64)), "root": pa.array(root)})
    return run


def forest(nodes: DataFrame, scratch: Scratch, *, threshold: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """(node, code) for every leaf that a node falls into."""
    counts = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    levels = max(1, min(MOST_LEVELS, 4 + math.ceil(math.log(max(1.0, counts / leaf)) / math.log(1 / 0.6)))) if counts > leaf else 0
    trees = trees_for(levels, trees)
    state = nodes.select("node", "label", "dim", "v").mapInArrow(
        _project(trees, max(levels, 1), seed), f"node long, label {nodes.schema['label'].dataType.simpleString()}, dim int, tree int, p array<float>")
    state = scratch.keep(state.withColumn("path", F.lit(1).cast("long")), "level-0")
    keys = ["label", "dim", "tree", "path"]
    # a linked pair is at most this far apart; random directions see 1/sqrt(dim) of it
    far = F.lit(math.sqrt(2 - 2 * threshold)) / F.sqrt("dim")
    density = F.greatest(*[F.lit(mass) / F.greatest(F.col("q")[b] - F.col("q")[a], F.lit(1e-30)) for mass, a, b in ((0.4, 0, 4), (0.2, 1, 3))])
    margins = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(y).alias("y")) for m, y in MARGINS])
    margin = F.get(F.filter(margins, lambda x: x["y"] * F.col("far") * F.col("density") <= CHANCE), F.lit(0))["m"] * F.col("far")
    idle = 0
    for k in range(levels):
        q = F.percentile_approx(F.col("p")[k], F.array(*[F.lit(x) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 1 - SHRINK, SHRINK)]), F.lit(2000))
        cuts = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), q.alias("q")).where(F.col("c") > leaf) \
            .select(*keys, "q", far.alias("far"), density.alias("density")).withColumn("margin", margin) \
            .select(*keys, (F.col("q")[2] - F.col("margin")).alias("lo"), (F.col("q")[2] + F.col("margin")).alias("hi"), "q") \
            .where("q[5] < lo AND hi < q[6]").drop("q")
        cuts = scratch.keep(cuts, f"cuts-{k}")
        idle = 0 if cuts.head(1) else idle + 1
        if idle == 4:                       # four directions in a row cut nothing
            break
        if idle:
            continue
        sides = F.when(F.col("lo").isNull(), F.array("path")).otherwise(F.filter(F.array(
            F.when(F.col("p")[k] <= F.col("hi"), F.col("path") * 2), F.when(F.col("p")[k] >= F.col("lo"), F.col("path") * 2 + 1)),
            lambda x: x.isNotNull()))
        state = state.join(cuts, keys, "left").select("node", "label", "dim", "tree", "p", F.explode(sides).alias("path"))
        state = scratch.keep(state, f"level-{k + 1}")
    # what one tree leaves whole is compared whole there: the other trees add nothing
    whole = state.where("path = 1").groupBy("label", "dim").agg(F.min("tree").alias("whole"))
    return state.join(whole, ["label", "dim"], "left").where("whole IS NULL OR tree = whole").select("node", F.xxhash64(*keys).alias("code"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, seed: int = 7,
                    scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``."""
    scratch = scratch or Scratch(vectors.sparkSession, "forest")
    v = F.col(vector_col)
    good = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) \
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, F.col(label_col)).alias("label"), F.when(good, v).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    rows = scratch.keep(rows, "rows")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least")) \
        .withColumn("dim", F.size("v"))
    nodes = scratch.keep(nodes, "nodes")
    leaves = scratch.keep(forest(nodes, scratch, threshold=threshold, trees=trees, leaf=leaf, seed=seed).distinct(), "leaves")
    chunks = leaves.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("parts"))
    chunks = scratch.keep(chunks, "chunks")
    full = nodes.join(leaves.groupBy("node").agg(F.sort_array(F.collect_list("code")).alias("codes")), "node")
    d = full.withColumn("code", F.explode("codes")).join(chunks, "code")
    d = d.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    d = d.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    d = d.select("code", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "node", "m", "dim", "v", "codes")
    found = scratch.keep(d.groupBy("code", "a", "b").applyInArrow(_compare(threshold), "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "groups") \
        .select("node", "root")
    mapped = nodes.select("node", "m", "least").join(links, "node", "left").join(roots, "node", "left") \
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"), "least")
    mapped = scratch.keep(mapped, "mapped")
    groups = mapped.groupBy("root").agg(F.min("least").alias("component"))
    per_node = scratch.keep(mapped.join(groups, "root").select("node", "n_links", "component"), "per-node")
    out = rows.select("id", "node").join(per_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
