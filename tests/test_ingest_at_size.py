import hashlib
import os

import pyarrow as pa
import pytest
from codeloom.functions.text import none_if_empty
from codeloom.operators.embed import embed_blocks, hashed_words
from codeloom.plans.ingest import ingest
from codeloom.schema import BLOCK_INDEX, conform
from codeloom.sources import block_index
from codeloom.sources.block_index import read_index
from codeloom.sources.files import discover_files
from pyspark.sql import functions as F
from test_ingest import statuses, tree, write  # noqa: F401


def test_a_task_hands_directories_back_after_many_files(spark, tmp_path, monkeypatch):
    from codeloom.sources import files

    write(str(tmp_path), {f"d{i}/x{j}.sql": "x" for i in range(4) for j in range(5)})
    asked = pa.RecordBatch.from_arrays([pa.array([str(tmp_path)])], ["file_path"])
    rows = [r for batch in files._lister(None, 8)([asked]) for r in batch.to_pylist()]
    assert sum(not r["is_dir"] for r in rows) == 10 and sum(r["is_dir"] for r in rows) == 2
    monkeypatch.setattr(files, "FILES_PER_TASK", 1)
    assert discover_files(spark, str(tmp_path)).count() == 20


def test_a_first_write_joins_with_no_old_rows(spark, tree, tmp_path, monkeypatch):
    plans, commit = [], block_index._commit

    def watched(rows, *others):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        commit(rows, *others)

    monkeypatch.setattr(block_index, "_commit", watched)
    target = str(tmp_path / "index")
    rows = conform(spark.createDataFrame([("a.sql", 0, "select 1")], "file_path string, ordinal int, content string"), BLOCK_INDEX)
    for _ in range(2):
        block_index.write_blocks(spark, target, rows, buckets=2)
    assert "Join" not in plans[0] and "Join" in plans[1]
    assert read_index(spark, target).count() == 1


def test_a_list_that_may_be_empty_is_worked_out_once(spark):
    frame = spark.createDataFrame([([],), (["a", "a"],), (None,)], "x array<string>")
    out = frame.select(none_if_empty(F.array_distinct("x")).alias("y"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
    assert [r["y"] for r in out.collect()] == [None, ["a"], None]


def test_equal_contents_in_two_families_are_indexed_once(spark, tmp_path):
    root, target = str(tmp_path / "s"), str(tmp_path / "i")
    both = "<cfquery name=\"q\">select 1</cfquery>"
    write(root, {"b.cfm": both, "a.html": both, "c.html": both, "d.java": "// none", "e.sql": "// none"})
    job = ingest(spark, root, target, hashed_words(16), buckets=2)
    assert statuses(job, root) == {
        "a.html": ("success", None),
        "b.cfm": ("skipped", "duplicate"),
        "c.html": ("skipped", "duplicate"),
        "d.java": ("skipped", "no blocks"),
        "e.sql": ("success", None),
    }
    assert {os.path.basename(r["file_path"]) for r in read_index(spark, target).collect()} == {"a.html", "e.sql"}


def test_hashed_words_counts_by_the_digest_of_each_word(spark):
    texts = ["A b b ünï_1", "", None, "b"]
    frame = spark.createDataFrame([(t,) for t in texts], "content string").coalesce(1)
    got = [r["embedding"] for r in embed_blocks(frame, hashed_words(8)).collect()]
    for text, vector in zip(texts, got, strict=True):
        counts = [0.0] * 8
        for word in (text or "").lower().split():
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 8] += 1
        length = sum(c * c for c in counts) ** 0.5 or 1.0
        assert vector == pytest.approx([c / length for c in counts])
