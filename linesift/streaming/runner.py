"""A resumable, idempotent table sink for streaming queries.

``run_into`` runs a query with ``trigger(availableNow=True)`` into a named folder:

    <folder>/checkpoint      the query's offsets and state
    <folder>/data/<batch>    the rows of a micro-batch, replaced if the batch is repeated
    <folder>/commits/<batch> an empty file, written after the batch's rows

Run again with the same folder, it goes on after the last committed batch.  A batch
that was killed before its commit is repeated by Spark and replaces its rows; what
has no commit is never read.  ``read_sink`` reads the committed rows: all of them in
append mode, the last batch in complete mode, each key's last version
(``latest_by``) in update mode.  ``fold_sink`` replaces the batches so far by one
table of last versions, so an update-mode sink keeps the size of its result.

``drain`` is a whole run into a fresh folder under ``spark.checkpoint.dir`` (replays
and tests).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

FOLDED = "upto-"


@dataclass(frozen=True)
class Run:
    """A finished run: its folder and Spark's progress reports."""
    folder: str
    progress: list[dict] = field(default_factory=list)

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    @property
    def dropped(self) -> int:
        """Events that were too late for any state."""
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])

    @property
    def state_rows(self) -> list[int]:
        """Rows of state after each batch."""
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in self.progress]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _commit(spark: SparkSession, folder: str, name: str) -> None:
    p, fs = _fs(spark, f"{folder}/commits/{name}")
    fs.create(p, True).close()


def run_into(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append",
             before_commit: Callable[[int], None] | None = None) -> Run:
    """Process all that has arrived since the folder's last commit.
    ``before_commit(batch)`` is called between a batch's rows and its commit."""
    folder = folder.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/data/{batch_id}")
        if before_commit:
            before_commit(batch_id)
        _commit(spark, folder, str(batch_id))

    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return Run(folder, list(q.recentProgress))


def _last_versions(df: DataFrame, latest_by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*latest_by).orderBy(F.desc("_batch"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def _committed(spark: SparkSession, folder: str, schema: T.StructType, mode: str) -> tuple[DataFrame | None, list[str]]:
    names = _names(spark, f"{folder}/commits")
    folded = max((int(n[len(FOLDED):]) for n in names if n.startswith(FOLDED)), default=-1)
    batches = sorted(int(n) for n in names if not n.startswith(FOLDED) and int(n) > folded)
    live = [str(b) for b in (batches[-1:] if mode == "complete" else batches)]
    live += [f"{FOLDED}{folded}"] if folded >= 0 and not (mode == "complete" and batches) else []
    if not live:
        return None, []
    full = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(full).parquet(*[f"{folder}/data/{n}" for n in live]), live


def read_sink(spark: SparkSession, folder: str, schema: T.StructType, mode: str = "append",
              latest_by: Sequence[str] | None = None) -> DataFrame:
    """The committed rows of a sink, in ``schema``."""
    rows, _ = _committed(spark, folder.rstrip("/"), schema, mode)
    if rows is None:
        return spark.createDataFrame([], schema)
    return (_last_versions(rows, latest_by) if latest_by else rows).drop("_batch")


def fold_sink(spark: SparkSession, folder: str, schema: T.StructType, latest_by: Sequence[str]) -> None:
    """Replace the committed batches of an update-mode sink by one table with each
    key's last version.  Readers see the batches until the table is committed."""
    folder = folder.rstrip("/")
    rows, live = _committed(spark, folder, schema, "update")
    if rows is None or len(live) < 2:
        return
    name = FOLDED + str(max(int(n.removeprefix(FOLDED)) for n in live))
    _last_versions(rows, latest_by).write.mode("overwrite").parquet(f"{folder}/data/{name}")
    _commit(spark, folder, name)
    for n in live:
        for part in ("commits", "data"):
            p, fs = _fs(spark, f"{folder}/{part}/{n}")
            fs.delete(p, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/linesift-{name}-{uuid.uuid4().hex}"


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append", name: str = "stream",
          latest_by: Sequence[str] | None = None) -> DataFrame:
    run = run_into(spark, stream, fresh_folder(spark, name), mode)
    return read_sink(spark, run.folder, stream.schema, mode, latest_by)
