"""one markdown file per document, but no folder per document."""

import glob
import os

from linesift.plans import edges
from linesift.plans.edges import _NAME_RE, scratch, write_checklists
from linesift.sources.logs import read_documents
from pyspark.sql import functions as F


def test_files_share_folders_and_keep_ids_and_texts(spark):
    rows = [(k, f"## Phase {k}\n- [ ] é {k}") for k in range(30)] + [(-5, "- [x] a"), (None, "no id"), (70, None), (71, "a"), (71, "a")]
    path = scratch(spark, "checklists")
    write_checklists(spark.createDataFrame(rows, "doc_id long, text string"), path)
    local = path.removeprefix("file:")
    assert len([f for f in os.listdir(local) if f.startswith("folder=")]) == 1
    assert len(glob.glob(f"{local}/*/part-*")) == 34                     # one per id
    got = read_documents(spark, path).select(
        F.regexp_extract("text", _NAME_RE, 1).try_cast("long").alias("id"), F.regexp_replace("text", _NAME_RE, "").alias("text"))
    want = {k: t + "\n" for k, t in rows if t is not None} | {70: "\n", 71: "a\na\n"}
    assert {r.id: r.text for r in got.collect()} == want


def test_files_are_read_some_folders_at_a_time(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(edges, "_FOLDER_FILES", 5)
    monkeypatch.setattr(edges, "_FOLDERS_AT_ONCE", 2)
    monkeypatch.setattr(edges, "read_documents", lambda s, p: asked.append(p) or read_documents(s, p))
    path = scratch(spark, "checklists")
    rows = [(k, f"- [ ] é {k}") for k in range(40)] + [(None, None)]
    write_checklists(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = edges.read_folders(spark, path)
    assert sorted(r.text.split("\n", 1)[1] for r in got.collect()) == sorted((t or "") + "\n" for _, t in rows)
    assert len(asked) > 2 and all(len(p) <= 2 for p in asked) and len({f for p in asked for f in p}) > 4


def test_no_process_is_started_for_a_file(spark):
    """Hadoop's local file system writes a checksum file beside each file and starts a
    process for both; other file systems take Spark's writer.  Both read the same."""
    docs = spark.createDataFrame([(k, f"## Phase {k}") for k in range(9)] + [(None, "none")], "doc_id long, text string")
    here, there = scratch(spark, "checklists"), scratch(spark, "checklists")
    write_checklists(docs, here)
    assert not glob.glob(here.removeprefix("file:") + "/*/.*")
    os.makedirs(there.removeprefix("file:"))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.checklists.link./in", "file://" + there.removeprefix("file:").removeprefix("//"))
    write_checklists(docs, "viewfs://checklists/in/files")
    got = [sorted(r.text for r in edges.read_folders(spark, p).collect()) for p in (here, "viewfs://checklists/in/files")]
    assert got[0] == got[1] and len(got[0]) == 10


def test_no_document_no_file(spark):
    path = scratch(spark, "checklists")
    write_checklists(spark.createDataFrame([], "doc_id long, text string"), path)
    assert edges.read_folders(spark, path).count() == 0
