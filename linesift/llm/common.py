"""Helpers shared by the operators: tables in the shared folder, names that
cannot clash, rank numbers without one task per key."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# What separates words: space and \t \n \v \f \r.  ``bytes.split()`` in the
# Python tasks cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


# Bytes of terms: ASCII letters (lowered), digits and all bytes of characters beyond
# ASCII stay, every other byte becomes a space.
TERM_BYTES = bytes((c | 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables written under ``spark.checkpoint.dir``.

    ``keep`` writes a frame as parquet and reads it back: its readers share one
    computation and the lineage ends there, so a lost executor repeats the tasks
    of one step only.  ``drop`` deletes a table that no later step reads; what is
    left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"
        self._path, fs = self._fs(self.root)
        fs.deleteOnExit(self._path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free_shuffles(self) -> None:
        """Spark deletes the shuffle files of a frame once the driver has collected
        its objects, which a small driver heap may not do for hours: ask for it
        between steps that shuffle whole texts."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            p, fs = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def binary(col: str) -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def row_key(id_col: str, text_col: str) -> Column:
    """128-bit key of a document row.  Rows equal in id and text are one
    document: they get the same key and are treated alike."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                             F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(F.col(text_col)))))


FILTER_WORDS = 1 << 18          # words of 62 bits of a row filter: 16 million bits


def likely_rows(df: DataFrame, hashed: Column, keys: DataFrame, keys_hashed: Column, n_keys: int) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash may be that of one of ``keys``: a bitmap of
    at most FILTER_WORDS rows is broadcast, so that a join that follows shuffles few
    other rows.  It loses none.  Beyond 16 keys a word it would pass most rows, and
    ``df`` comes back as it is."""
    if n_keys > 16 * FILTER_WORDS:
        return df
    word, bits = fresh(df, "_word", "_bits")

    def place(h: Column) -> tuple[Column, Column]:
        bit = F.pow(F.lit(2.0), F.pmod(h, F.lit(62))).cast("long")
        return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)), bit

    at, bit = place(keys_hashed)
    have = keys.select(at.alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    at, bit = place(hashed)
    return df.withColumn(word, at).join(F.broadcast(have), word).where(F.col(bits).bitwiseAND(bit) != 0).drop(word, bits)


def salts(count: Column, least: int = 512) -> Column:
    """Into how many parts a group of ``count`` rows is cut: parts of at most
    max(least, sqrt(count)) rows, so neither a part nor the list of a group's
    parts grows with more than the root of the group."""
    return F.greatest(F.lit(1), F.ceil(count / F.greatest(F.lit(float(least)), F.sqrt(count.cast("double"))))).cast("long")


def rank_in_group(df: DataFrame, group: str, counts: DataFrame, order: list[str], out: str, hint_small: bool) -> DataFrame:
    """Add the dense rank (0, 1, ...) of each row in its group, by salted parts.

    ``counts`` has (group, n).  ``hint_small``: the caller has checked that it is
    small enough to broadcast.  Rows equal in ``order`` are interchangeable.
    """
    n, salt, before, size = fresh(df, "_n", "_salt", "_before", "_size")
    c = counts.select(F.col(group), salts(F.col("n")).alias(n))
    d = df.join(F.broadcast(c) if hint_small else c, group)
    d = d.withColumn(salt, F.pmod(F.xxhash64(*order), F.col(n)))
    parts = d.groupBy(group, salt).agg(F.count(F.lit(1)).alias(size))
    w = Window.partitionBy(group).orderBy(salt)
    parts = parts.select(group, salt, (F.sum(size).over(w) - F.col(size)).alias(before))
    d = d.join(parts, [group, salt])
    inside = Window.partitionBy(group, salt).orderBy(*order)
    return d.withColumn(out, F.col(before) + F.row_number().over(inside) - 1).drop(n, salt, before)
