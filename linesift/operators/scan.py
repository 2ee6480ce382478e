"""Ordered scans over a key without putting one key in one task.

Compaction and sessionization need ordered state per key: the previous line,
a running count, the start of the current run.  A plain
``Window.partitionBy(key).orderBy(pos)`` puts all rows of one key into one task,
so one huge output (or one hot user) would serialize the job.

``segmented_scan`` uses the two-level form instead:

1. rows are cut into chunks ``(key, floor(pos / chunk_rows))``;
2. one small summary row per chunk is aggregated (map-side partial aggregation);
3. carries (sum of earlier chunks, last value of the previous chunk, ...) are
   computed by windows over the summary table, which has ``rows / chunk_rows``
   entries per key;
4. the summary is joined back on ``(key, chunk)`` and the final value is an
   in-chunk window plus the carry.

The input is repartitioned by ``(key, chunk)`` and persisted (``materialize``):
the summary branch and the main branch both read it, and the persisted frame
keeps the hash partitioning, so neither the summary aggregate nor the in-chunk
windows shuffle the big table again.  A table that may be read twice (``leaf``) is
not persisted: the summary is aggregated before the shuffle.  Operators that stack scans also ``cut``
their plan: they write a table under ``spark.checkpoint.dir`` and read it back,
so lineage ends there and a lost executor costs one level.

Every window on the big table is partitioned by ``(key, chunk)``: at most
``chunk_rows`` rows per window partition, whatever the key skew.

Rows with a NULL key form a group of their own, and rows with a NULL position
come first in their group: no row is dropped.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_COL = "_chunk"
DEFAULT_CHUNK_ROWS = 1 << 16


_PERSISTED: ContextVar[list[DataFrame]] = ContextVar("persisted")
_UNSCOPED: list[DataFrame] = []


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for its several readers: lazy ``persist``, spilled to
    disk under memory pressure; a lost executor's blocks are recomputed.  The blocks
    are freed at the end of the ``scope`` around the report, or by ``release``."""
    from pyspark import StorageLevel
    _PERSISTED.get(_UNSCOPED).append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


@contextmanager
def scope() -> Iterator[None]:
    """Free what operators persist inside this block (build a report and write it
    there) when it ends, and nothing of other callers."""
    mine: list[DataFrame] = []
    token = _PERSISTED.set(mine)
    try:
        yield
    finally:
        _PERSISTED.reset(token)
        for df in mine:
            df.unpersist()


def release() -> None:
    """Unpersist what operators have persisted outside of any ``scope``."""
    while _UNSCOPED:
        _UNSCOPED.pop().unpersist()


_CUTS: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


def _cut_path(spark) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` that goes when the application ends."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/linesift-cut-{uuid.uuid4().hex}"
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    return path


def _folder(spark, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table into ``spark.checkpoint.dir`` and read it
    back: the result is a leaf (plan and lineage cut).  Used at the entry of
    operators that stack several two-level scans, so their plans do not grow
    with the input's plan.  (Every reader repartitions anyway, so the table
    need not keep a partitioning.)  The folder goes when the application ends, or
    with the part of ``cut_parts`` that it belongs to."""
    spark = df.sparkSession
    path = _cut_path(spark)
    if (mine := _CUTS.get()) is not None:
        mine.append(path)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_parts(spark, parts: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """``cut`` of the union of several frames (columns by name, types of the first),
    each built and written on its own: what a part has persisted, cut and shuffled on
    its way is freed before the next begins, so the disk holds the work of one part at
    a time.  ``parts`` build their frames when called, and must not hand them on."""
    path, schema = _cut_path(spark), None
    if (outer := _CUTS.get()) is not None:
        outer.append(path)
    for part in parts:
        mine: list[str] = []
        token = _CUTS.set(mine)
        try:
            with scope():
                df = part()
                schema = schema or df.schema
                _write(df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), path)
                del df
        finally:
            _CUTS.reset(token)
            for p in mine:
                folder, fs = _folder(spark, p)
                fs.delete(folder, True)
            free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark) -> None:
    """Spark deletes the shuffle files of a frame once the driver has collected its
    objects, which may take hours: ask for it between steps that shuffle much."""
    import gc
    gc.collect()
    spark._jvm.System.gc()


# What stands for NULL beside a flag, by type; other types are compared as text.
_ZERO = {"string": "", "bigint": 0, "int": 0, "smallint": 0, "tinyint": 0, "double": 0.0, "float": 0.0}


def null_safe_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add non-null stand-ins for ``keys`` (a value and an is-null flag each), so
    that plain equi-joins and partitionings keep the rows with NULL keys."""
    cols, names = {}, []
    for i, k in enumerate(keys):
        if is_wrapped(df.schema[k]):
            names.append(k)
            continue
        kind = df.schema[k].dataType.simpleString()
        value = F.coalesce(F.col(k), F.lit(_ZERO[kind]).cast(kind)) if kind in _ZERO else F.coalesce(F.col(k).cast("string"), F.lit(""))
        cols |= {f"_key{i}": value, f"_null{i}": F.col(k).isNull()}
        names += [f"_key{i}", f"_null{i}"]
    return df.withColumns(cols), names


# The first field of a struct that stands for a key: such a struct is never NULL, and
# equal to another exactly where the keys are equal or both NULL.
WRAPPED = "_k"


def is_wrapped(f: StructField) -> bool:
    return isinstance(f.dataType, StructType) and f.dataType.names[:1] == [WRAPPED]


def wrap_key(df: DataFrame, key: str) -> DataFrame:
    return df if is_wrapped(df.schema[key]) else df.withColumn(key, F.struct(F.col(key).alias(WRAPPED)))


def unwrap_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f"{f.name}.{WRAPPED}") for f in df.schema.fields if is_wrapped(f)})


def keeps_null_keys(*frames: str) -> Callable:
    """For operators that join on ``output_id`` (or their ``key``): the arguments
    named get their key wrapped, so plain equi-joins keep the rows of a NULL key as an
    output of its own; the results get it back.  Inside another such operator keys are
    wrapped already, and stay so."""
    def deco(fn: Callable) -> Callable:
        shape = inspect.signature(fn)

        @functools.wraps(fn)
        def run(*args, **kwargs):
            given = shape.bind(*args, **kwargs)
            given.apply_defaults()
            keys = {}
            for f in frames:
                df, key = given.arguments[f], given.arguments.get("key", "output_id")
                keys[f] = key if key in df.columns else "output_id"
            if all(is_wrapped(given.arguments[f].schema[k]) for f, k in keys.items()):
                return fn(*given.args, **given.kwargs)
            for f, k in keys.items():
                given.arguments[f] = wrap_key(given.arguments[f], k)
            out = fn(*given.args, **given.kwargs)
            return tuple(map(unwrap_keys, out)) if isinstance(out, tuple) else unwrap_keys(out)
        return run
    return deco


def with_chunk(df: DataFrame, pos: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add the chunk column (no-op if present)."""
    if CHUNK_COL in df.columns:
        return df
    return df.withColumn(CHUNK_COL, F.coalesce(F.floor(F.col(pos) / F.lit(chunk_rows)).cast("long"), F.lit(-1).cast("long")))


def segmented_scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    *,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    running_sum: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    next_min: Mapping[str, Column] | None = None,
    total_sum: Mapping[str, Column] | None = None,
    total_max: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    distinct: bool = False,
    dealt: bool = False,
    leaf: bool = False,
) -> DataFrame:
    """Add ordered-scan columns over ``keys`` ordered by ``pos``.

    * ``running_sum``  out -> expr: inclusive running sum (NULL counts as 0).
    * ``running_max``  out -> expr: inclusive running max, NULLs ignored.
    * ``next_min``     out -> expr: min over rows strictly *after* this row.
    * ``total_sum``    out -> expr: sum over the whole key.
    * ``total_max``    out -> expr: max over the whole key, NULLs ignored.
    * ``previous``     out -> column: value of that column on the previous row.

    ``pos`` must be unique within a key; with ``distinct``, rows that repeat a
    position are the same row and count once.  ``previous`` follows the previous
    existing row, so positions need not be dense.

    ``dealt``: ``df`` comes from an earlier scan over the same keys and still has its
    chunk column, whose order ``pos`` follows: its rows are where they belong, and are
    neither shuffled nor persisted again (what lies between the scans is computed for
    the summary and once more for the rows).

    ``leaf``: ``df`` is a table that may be read twice (``cut``): the summary is counted
    where the rows lie, and they are shuffled without being persisted, with no more
    columns than the result asks for.
    """
    if leaf and (distinct or dealt):
        raise ValueError("leaf goes with neither distinct nor dealt")
    running_sum = dict(running_sum or {})
    running_max = dict(running_max or {})
    next_min = dict(next_min or {})
    total_sum = dict(total_sum or {})
    total_max = dict(total_max or {})
    previous = dict(previous or {})

    d, keys = null_safe_keys(with_chunk(df, pos, chunk_rows), keys)
    tmp = {}
    for group in (running_sum, running_max, next_min, total_sum, total_max):
        for out, expr in group.items():
            name = f"_v_{out}"
            tmp[out] = name
            d = d.withColumn(name, expr)
    if not (dealt or leaf):
        d = d.repartition(*keys, CHUNK_COL)
    if distinct:
        d = d.dropDuplicates([*keys, CHUNK_COL, pos])            # inside the partitions: no shuffle
    if not (dealt or leaf):
        d = materialize(d)

    aggs = []
    for out in running_sum:
        aggs.append(F.sum(tmp[out]).alias(f"_s_{out}"))
    for out in running_max:
        aggs.append(F.max(tmp[out]).alias(f"_m_{out}"))
    for out in next_min:
        aggs.append(F.min(tmp[out]).alias(f"_r_{out}"))
    for out in total_sum:
        aggs.append(F.sum(tmp[out]).alias(f"_t_{out}"))
    for out in total_max:
        aggs.append(F.max(tmp[out]).alias(f"_x_{out}"))
    for out, col in previous.items():
        aggs.append(F.max_by(F.col(col), F.col(pos)).alias(f"_p_{out}"))

    summary = d.groupBy(*keys, CHUNK_COL).agg(*aggs)
    wk = Window.partitionBy(*keys).orderBy(CHUNK_COL)
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    # rows after = growing frame of the descending order (a shrinking
    # "unbounded following" frame is evaluated in O(n^2) by Spark)
    after = Window.partitionBy(*keys).orderBy(F.col(CHUNK_COL).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carries = [F.col(k) for k in keys] + [F.col(CHUNK_COL)]
    for out in running_sum:
        carries.append(F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_cs_{out}"))
    for out in running_max:
        carries.append(F.max(f"_m_{out}").over(before).alias(f"_cm_{out}"))
    for out in next_min:
        carries.append(F.min(f"_r_{out}").over(after).alias(f"_cr_{out}"))
    for out in total_sum:
        carries.append(F.coalesce(F.sum(f"_t_{out}").over(whole), F.lit(0)).alias(f"_ct_{out}"))
    for out in total_max:
        carries.append(F.max(f"_x_{out}").over(whole).alias(f"_cx_{out}"))
    for out in previous:
        carries.append(F.lag(f"_p_{out}").over(wk).alias(f"_cp_{out}"))
    summary = summary.select(*carries)

    d = d.join(summary, on=[*keys, CHUNK_COL], how="inner")
    wc = Window.partitionBy(*keys, CHUNK_COL).orderBy(pos)
    upto = wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy(*keys, CHUNK_COL).orderBy(F.col(pos).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)

    outs = []
    for out in running_sum:
        outs.append((out, F.coalesce(F.sum(tmp[out]).over(upto), F.lit(0)) + F.col(f"_cs_{out}")))
    for out in running_max:
        outs.append((out, F.greatest(F.max(tmp[out]).over(upto), F.col(f"_cm_{out}"))))
    for out in next_min:
        outs.append((out, F.least(F.min(tmp[out]).over(rest), F.col(f"_cr_{out}"))))
    for out in total_sum:
        outs.append((out, F.col(f"_ct_{out}")))
    for out in total_max:
        outs.append((out, F.col(f"_cx_{out}")))
    for out, col in previous.items():
        outs.append((out, F.when(F.row_number().over(wc) == 1, F.col(f"_cp_{out}"))
                     .otherwise(F.lag(col).over(wc))))
    d = d.withColumns(dict(outs))
    drop = [c for c in d.columns if c.startswith(("_v_", "_s_", "_m_", "_r_", "_t_", "_p_",
                                                    "_cs_", "_cm_", "_cr_", "_ct_", "_cp_", "_x_", "_cx_"))]
    return d.drop(*drop, *(k for k in keys if k.startswith(("_key", "_null"))))
