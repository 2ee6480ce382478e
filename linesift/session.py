"""SparkSession helpers.

Library code never creates a session on its own; it takes the caller's.
``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here assumes: UTC timestamps (E12, S3), AQE for skewed
# joins and partition coalescing, no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "linesift") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LINESIFT_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints, plan cuts and stream state.

    On a cluster ``spark.checkpoint.dir`` names a shared folder: it is read from
    the session and used as is.  Only where it is unset (local runs, tests) the
    SparkContext gets a fresh scratch folder.  ``spark.checkpoint.dir`` itself is
    never written (Spark rejects changing core settings at runtime).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:                     # no SparkContext in this process (remote client)
        if current:
            return current
        raise RuntimeError("spark.checkpoint.dir must name a shared folder for this session")
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):        # other hosts cannot see a folder of this one
        raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
    path = tempfile.mkdtemp(prefix="linesift-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
