"""Sources (S1-S8) and sinks (K1) of invocation logs and agent event logs.

Layouts read:
* the tool's own layout: one ``<session>.jsonl`` file per session, chosen by the
  file's stem whatever the records inside say; only that file is listed and read;
* our sink's layout: ``day=<date>/part-*`` (written by ``write_invocations``), or
  ``day=<date>/bucket=<k>-of-<n>/part-*`` with sessions hashed to buckets; a time
  range prunes days, a session its bucket, and is chosen by the id inside the
  record.  Ids never become folder names.

Every line is read as text and parsed field by field (``try_parse_json``), in batch
and in streams alike: a line is one JSON object as Python's ``json.loads`` takes it
after ``strip`` (Unicode white space around it, keys that repeat, of which the last
counts, NaN and infinities).  A mistyped field, and a number that is none, is NULL (
3.0 and "3" are a 3);
any other line is skipped.  Repeated keys ask for the session's
``spark.sql.variant.allowDuplicateKeys``, which the readers switch on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip, token_estimate

# The invocation record (13 fixed + 2 optional fields), read leniently.
INVOCATION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("session_started_at", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("context_root", T.StringType()),
    T.StructField("in_git_repo", T.BooleanType()),
    T.StructField("command", T.StringType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("stdout_bytes", T.LongType()),
    T.StructField("stdout_lines", T.LongType()),
    T.StructField("estimated_tokens", T.LongType()),
    T.StructField("stderr_bytes", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("compressed_lines", T.LongType()),
    T.StructField("full", T.BooleanType()),
])

# Flavour A agent events (superset of the fields used).
THREAD_EVENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("item", T.StructType([T.StructField("type", T.StringType()),
                                        T.StructField("command", T.StringType())])),
    T.StructField("usage", T.StructType([T.StructField("input_tokens", T.LongType()),
                                         T.StructField("cached_input_tokens", T.LongType()),
                                         T.StructField("output_tokens", T.LongType())])),
])

# Flavour B agent events.
MESSAGE_EVENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message", T.StructType([T.StructField("content", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("input", T.StructType([T.StructField("command", T.StringType())]))])))])),
    T.StructField("usage", T.StructType([T.StructField("input_tokens", T.LongType()),
                                         T.StructField("cache_read_input_tokens", T.LongType()),
                                         T.StructField("cache_creation_input_tokens", T.LongType()),
                                         T.StructField("output_tokens", T.LongType())])),
    T.StructField("result", T.StringType()),
])

# Benchmark cases.
CASE_SCHEMA = T.StructType([T.StructField("command", T.StringType()),
                            T.StructField("args", T.ArrayType(T.StringType()))])

# Tokens that json.loads takes for numbers and JSON has not; strings are skipped.
_STRING_OR_NAN = '("(?:[^"\\\\]|\\\\.)*+")|(-?Infinity|NaN)'
_MARK = "\x01"                   # stands in no JSON text, where control characters are escaped


def _text(value: Column) -> Column:
    """The stripped line with null for NaN and infinities outside strings."""
    line = py_strip(value)
    marked = F.regexp_replace(line, _STRING_OR_NAN, f"$1{_MARK}$2")
    fixed = F.regexp_replace(F.replace(marked, F.lit(f'"{_MARK}'), F.lit('"')), f"{_MARK}(-?Infinity|NaN)", "null")
    return F.when((line.contains("NaN") | line.contains("Infinity")) & ~line.contains(_MARK), fixed).otherwise(line)


def json_object(value: Column) -> Column:
    """The line as a VARIANT if it is one JSON object and nothing else, else NULL.
    (The parser stops after a value; inside brackets it must come to their end.)"""
    line = _text(value)
    v = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    one = line.startswith("{") & line.endswith("}") & F.try_variant_get(v, "$[1]", "variant").isNull()
    closed = F.when(line.rlike("\\}\\s*\\]"), F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}"))).isNotNull()).otherwise(True)
    return F.when(one & closed, F.try_variant_get(v, "$[0]", "variant"))


def _allow_repeated_keys(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _field(v: Column, f: T.StructField) -> Column:
    """One field, NULL where it is missing or of another type (3.0 is a 3)."""
    return F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name)


def parse_ts(c: Column) -> Column:
    """ISO-8601 text (offset and microseconds allowed) -> TIMESTAMP; bad -> NULL."""
    return F.try_to_timestamp(c)


def _parse_invocations(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    d = raw.withColumn("_v", json_object(F.col("value"))).where(F.col("_v").isNotNull())
    d = d.select(*keep, *[_field(F.col("_v"), f) for f in INVOCATION_SCHEMA.fields])
    return d.withColumn("ts", parse_ts(F.col("timestamp")))


def read_invocations(spark: SparkSession, path: str, session_id: str | None = None,
                     since=None, until=None) -> DataFrame:
    """S1 (+ S2 session, S3 inclusive time range).  Blank lines, bad JSON and
    lines that are no object give no row; every other line gives one."""
    _allow_repeated_keys(spark)
    raw = spark.read.text(path)
    if "day" in raw.columns:                                     # our sink's folders: prune days and buckets
        day = F.col("day").cast("string")
        if since is not None:
            raw = raw.where((day != "unknown") & (day >= F.date_format(F.lit(since).cast("timestamp"), "yyyy-MM-dd")))
        if until is not None:
            raw = raw.where((day == "unknown") | (day <= F.date_format(F.lit(until).cast("timestamp"), "yyyy-MM-dd")))
        if session_id is not None and "bucket" in raw.columns:
            n = F.substring_index("bucket", "-of-", -1).cast("int")
            raw = raw.where(F.col("bucket") == _bucket(F.lit(session_id), n))
        df = _parse_invocations(raw.select("value"))
        if session_id is not None:
            df = df.where(F.col("session_id") == session_id)
    elif session_id is None:
        df = _parse_invocations(raw.select("value"))
    elif "/" in session_id:                                      # no file has such a name
        df = _parse_invocations(raw.select("value").limit(0))
    else:                                                        # a file per session
        named = spark.read.option("pathGlobFilter", _glob(session_id) + ".jsonl").text(path)
        df = _parse_invocations(named.select("value"))
    if since is not None:
        df = df.where(F.col("ts").isNotNull() & (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until is not None:
        df = df.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(until).cast("timestamp")))
    return df


def _bucket(session_id: Column, n: Column) -> Column:
    return F.concat(F.pmod(F.xxhash64(F.coalesce(session_id, F.lit(""))), n).cast("string"), F.lit("-of-"), n.cast("string"))


def _glob(name: str) -> str:
    """A file name pattern that matches ``name`` alone."""
    return "".join("\\" + c if c in "\\[]{}*?,^-" else c for c in name)


def stream_invocations(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Tail a log directory as a stream, parsed as in S1.  Producers must add
    new files (``write_invocations`` does); Spark's file source treats a seen
    file as final."""
    _allow_repeated_keys(spark)
    r = spark.readStream.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _parse_invocations(r.text(path))


def to_log_records(facts: DataFrame) -> DataFrame:
    """Invocation facts -> log records (K1 shape).  ``compressed_lines`` stays
    NULL when unchanged and ``full`` is NULL unless the call bypassed, so the
    JSON writer omits them as the tool does."""
    cols = {
        "timestamp": F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"),
        "estimated_tokens": token_estimate(F.col("stdout_bytes")),
        "stderr_bytes": F.coalesce(F.col("stderr_bytes"), F.lit(0).cast("long")) if "stderr_bytes" in facts.columns
        else F.lit(0).cast("long"),
        "exit_code": F.coalesce(F.col("exit_code"), F.lit(0)) if "exit_code" in facts.columns else F.lit(0),
        "full": F.when(F.coalesce(F.col("full"), F.lit(False)), F.lit(True)),
    }
    d = facts.withColumns(cols)
    names = [f.name for f in INVOCATION_SCHEMA.fields]
    return d.select(*[F.col(n) if n in d.columns else F.lit(None).cast(INVOCATION_SCHEMA[n].dataType).alias(n)
                      for n in names])


def write_invocations(records: DataFrame, path: str, buckets: int | None = None) -> None:
    """K1: append records as JSON lines, one folder per UTC day (NULL fields are
    omitted by the JSON writer).  The session id stays inside the record.  No
    repartition: every task writes its own file per day it holds, so a hot
    session or day is spread over tasks.  With ``buckets``, sessions are hashed to so
    many folders of each day, of which a session's reader opens one; a folder must be
    written with or without buckets throughout."""
    day = F.coalesce(F.date_format(parse_ts(F.col("timestamp")), "yyyy-MM-dd"), F.lit("unknown"))
    folders = {"day": day} | ({"bucket": _bucket(F.col("session_id"), F.lit(buckets))} if buckets else {})
    records.withColumns(folders).write.mode("append").partitionBy(*folders).json(path)


def read_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every worded line of every JSONL file with its 0-based position:
    ``file, line_no, value``.  Files are split like any text input; a split's
    lines are numbered from the counts of the file's earlier splits."""
    _allow_repeated_keys(spark)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    d = lines.join(blocks, ["file", "block"])
    return d.select("file", (F.col("before") + F.col("row") - F.col("first")).alias("line_no"), "value") \
        .where(py_strip(F.col("value")) != "")


def _run_id(file: Column) -> Column:
    """Run id of a log file: its stem (paths in ``_metadata`` are percent-escaped)."""
    name = F.regexp_extract(file, "([^/]+?)(\\.[^./]*)?$", 1)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def _events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A record's own ``run_id`` and ``line_no`` (our sink) go before the file's stem and position."""
    lines = read_jsonl_lines(spark, path).withColumn("_v", json_object(F.col("value"))).where(F.col("_v").isNotNull())
    return lines.select(
        F.coalesce(F.try_variant_get("_v", "$.run_id", "string"), _run_id(F.col("file"))).alias("run_id"),
        F.coalesce(F.try_variant_get("_v", "$.line_no", "bigint"), F.col("line_no")).alias("line_no"),
        F.from_json(_text(F.col("value")), schema, {"mode": "PERMISSIVE"}).alias("e")).select("run_id", "line_no", "e.*")


def read_thread_events(spark: SparkSession, path: str) -> DataFrame:
    """Flavour A events with ``run_id`` and ``line_no`` (bad lines skipped)."""
    return _events(spark, path, THREAD_EVENT_SCHEMA)


def read_message_events(spark: SparkSession, path: str) -> DataFrame:
    """Flavour B events with ``run_id`` and ``line_no`` (bad lines skipped)."""
    return _events(spark, path, MESSAGE_EVENT_SCHEMA)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases; blank/bad lines and empty commands skipped."""
    lines = read_jsonl_lines(spark, path).withColumn("_v", json_object(F.col("value"))).where(F.col("_v").isNotNull())
    command, args = (_field(F.col("_v"), f) for f in CASE_SCHEMA.fields)
    d = lines.select(F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("case_id"), command, args)
    return d.where(F.col("command") != "").withColumn("args", F.coalesce("args", F.array().cast("array<string>")))


def write_events(events: DataFrame, path: str) -> None:
    """Append event rows (``run_id, line_no`` + event fields) as JSON lines.  Run
    and position stay inside the record, so a long run is no single task and a
    run no folder."""
    events.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown checklists (or any text files), one row per file."""
    return spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("path"),
                                                             F.col("content").cast("string").alias("text"))
