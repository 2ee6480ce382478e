"""Operator inputs derived from the driver tables.

No log, search, diff or listing corpus is supplied, so each operator's input is
a deterministic projection of the given tables (the same projection is written
in SQL for the DuckDB oracle in ``catalog.py``).  Every derivation keeps all rows
of its table: the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as captured outputs: one output per document, command = source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("output_id"), F.col("source").alias("command"),
        F.array().cast("array<string>").alias("args"), F.col("text").alias("stdout"))


def event_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an invocation log.

    command = event_type; session = 's' || user_id; args = [props];
    stdout_lines = the ``k`` number in props; stdout_bytes = floor(value * 100);
    a call is a bypass (``full``) when it is an error with k < 10;
    ``compressed_lines`` is absent for views, equal to the raw count for clicks
    (logged as compacted but saving nothing) and k / 2 otherwise.
    """
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k":\\s*(-?\\d+)', 1).try_cast("long")
    return ev.select(
        F.col("event_id"), F.col("ts"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("command"),
        F.array(F.col("props")).alias("args"),
        F.floor(F.col("value") * 100).cast("long").alias("stdout_bytes"),
        k.alias("stdout_lines"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("long"))
         .when(F.col("event_type") == "click", k)
         .otherwise(F.floor(k / 2).cast("long")).alias("compressed_lines"),
        ((F.col("event_type") == "error") & (k < 10)).alias("full"))
