import hashlib
import os

import pytest
from codeloom.functions.text import stem, strip, suffix
from codeloom.operators.catalog import get_file_blocks, list_indexed_files
from codeloom.operators.embed import client_embedder, hashed_words
from codeloom.plans.ingest import ingest
from codeloom.sources import block_index
from codeloom.sources.block_index import read_index
from codeloom.sources.files import check_root, discover_files, fingerprint, read_files, read_text
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TREE = {
    "a/A.java": "import x.y;\nclass A extends B {\n @Inject private C c;\n void m() { c.go(); } }",
    "a/B.JAVA": "class B { B2 b() { return null; } }",
    ".git/x.sql": "select 1; drop table x",
    "_inc/_form.cfm": '<cfcomponent displayname="K1">\n<cffunction name="f"></cffunction>\n</cfcomponent>',
    "C.java": "class C { }",
    "copy/C.java": "class C { }",
    "e.html": "no tags",
    "n.txt": "class N { }",
    ".java": "class H { }",
    ".hidden.java": "class I { }",
}


def write(root, files):
    for path, text in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as handle:
            handle.write(text if isinstance(text, bytes) else text.encode())


def statuses(job, root):
    return {
        os.path.relpath(r["file_path"], root): (r["status"], r["reason"]) for r in job.outcomes.collect()
    }


@pytest.fixture()
def tree(tmp_path):
    root = str(tmp_path / "src")
    write(root, TREE)
    return root


def test_discovery_includes_hidden_names(spark, tree):
    found = {os.path.relpath(r["file_path"], tree) for r in discover_files(spark, tree).collect()}
    assert found == set(TREE) - {"n.txt", ".java"}
    assert check_root(spark, tree) and not check_root(spark, tree + "/none")


def test_deep_trees_are_handed_back_and_forth(spark, tmp_path, monkeypatch):
    from codeloom.sources import files

    monkeypatch.setattr(files, "DIRECTORIES_PER_TASK", 2)
    write(str(tmp_path), {f"d{i}/e{j}/f/x{i}{j}.sql": "x" for i in range(4) for j in range(4)})
    assert discover_files(spark, str(tmp_path)).count() == 16


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=30))
def test_text_and_hash_of_any_bytes(spark, raw):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, content binary")
    for row in read_text(fingerprint(frame)).collect():
        assert row["text"] == raw[row["i"]].decode("utf-8", errors="replace")
        assert row["file_sha256"] == hashlib.sha256(raw[row["i"]]).hexdigest()


def test_unreadable_file_has_an_error(spark, tree):
    frame = spark.createDataFrame([(tree + "/gone.sql", 3), (tree + "/C.java", 3)], "file_path string, length bigint")
    rows = {os.path.basename(r["file_path"]): r for r in read_files(frame, tree).collect()}
    assert "FileNotFoundError" in rows["gone.sql"]["error"] and rows["C.java"]["error"] is None


def test_path_idioms(spark):
    cases = {"a/b.c.JAVA": (".java", "b.c"), ".java": ("", ".java"), "x/..java": (".java", "."), "n": ("", "n"), "a.b/c": ("", "c"), "a.": ("", "a.")}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", suffix(F.col("p")).alias("s"), stem(F.col("p")).alias("t"))
    assert {r["p"]: (r["s"], r["t"]) for r in rows.collect()} == cases
    blank = spark.range(1).select(strip(F.lit("\t\n  a b  \n")).alias("x")).first()["x"]
    assert blank == "a b"


def test_ingest_life_cycle(spark, tree, tmp_path):
    target = str(tmp_path / "index")
    first = ingest(spark, tree, target, hashed_words(16), "oracle", buckets=4)
    assert first.status == "completed"
    assert statuses(first, tree) == {
        "a/A.java": ("success", None),
        "a/B.JAVA": ("success", None),
        ".git/x.sql": ("success", None),
        "_inc/_form.cfm": ("success", None),
        ".hidden.java": ("success", None),
        "C.java": ("success", None),
        "copy/C.java": ("skipped", "duplicate"),
        "e.html": ("skipped", "no blocks"),
    }
    metrics = first.metrics.first()
    assert (metrics["files_discovered"], metrics["files_processed"], metrics["files_skipped"]) == (8, 6, 2)
    assert metrics["blocks_inserted"] == read_index(spark, target).count() == 10
    ids = {r["id"] for r in read_index(spark, target).collect()}
    assert len(ids) == 10

    write(tree, {"a/A.java": "class A { void n() { } }", "C.java": "// nothing left", "e2.html": "<p>new</p>"})
    second = ingest(spark, tree, target, hashed_words(16), "oracle")
    done = statuses(second, tree)
    assert done["a/A.java"] == done["e2.html"] == ("success", None)
    assert done["C.java"] == ("skipped", "no blocks")  # its old rows stay
    assert done["copy/C.java"] == ("skipped", "duplicate")
    index = read_index(spark, target)
    counts = {os.path.relpath(r["file_path"], tree): r["block_count"] for r in list_indexed_files(index).collect()}
    assert counts == {"a/A.java": 2, "a/B.JAVA": 2, ".git/x.sql": 2, "_inc/_form.cfm": 2, ".hidden.java": 1, "C.java": 1, "e2.html": 1}
    path = tree + "/a/A.java"
    rows = get_file_blocks(read_index(spark, target, path), path).collect()
    assert [r["content"] for r in rows] == ["class A { void n() { } }", "void n() { }"]

    block_index.purge(spark, target, tree + "/a/")
    assert read_index(spark, target).count() == 7
    block_index.purge(spark, target)
    assert read_index(spark, target).count() == 0
    again = ingest(spark, tree, target, hashed_words(16))
    assert again.metrics.first()["files_processed"] == 7  # only C.java and e.html have no blocks


def test_a_failing_embedder_fails_only_its_file(spark, tmp_path):
    root, target = str(tmp_path / "s"), str(tmp_path / "i")
    write(root, {"a.sql": "select 1; select 'bad'", "b.sql": "select 2"})

    def factory():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return [[1.0, 2.0] for _ in texts]

        return call

    job = ingest(spark, root, target, client_embedder(factory), buckets=2)
    assert statuses(job, root) == {"a.sql": ("failed", "error"), "b.sql": ("success", None)}
    assert [r["content"] for r in read_index(spark, target).collect()] == ["select 2"]


def test_missing_root_fails(spark, tmp_path):
    job = ingest(spark, str(tmp_path / "none"), str(tmp_path / "i"))
    assert job.status == "failed" and job.metrics.first()["files_discovered"] == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    state = {"version": 1, "buckets": 2, "folders": {}}
    block_index._publish(spark, str(tmp_path / "i"), state)
    with pytest.raises(RuntimeError):
        block_index._publish(spark, str(tmp_path / "i"), state)


def test_a_store_is_listed_and_read_like_a_mount(spark, tree, monkeypatch):
    from codeloom.sources import files

    mounted = {(r["file_path"], r["length"]) for r in discover_files(spark, tree).collect()}
    contents = {r["file_path"]: bytes(r["content"]) for r in read_files(discover_files(spark, tree), tree).collect()}
    root = "file://" + tree
    monkeypatch.setattr(files, "mounted_path", lambda root: None)
    monkeypatch.setattr(files, "DIRECTORIES_PER_TASK", 2)
    monkeypatch.setattr(files, "ROWS", 3)
    listed = discover_files(spark, root)
    assert {(r["file_path"].removeprefix("file://"), r["length"]) for r in listed.collect()} == mounted
    read = {r["file_path"].removeprefix("file://"): bytes(r["content"]) for r in read_files(listed, root).collect()}
    assert read == contents
    gone = spark.createDataFrame([(root + "/gone.sql", 3)], "file_path string, length bigint")
    assert "FileNotFoundError" in read_files(gone, root).first()["error"]
    missing = files.list_files(spark, root + "/none").collect()
    assert [(r["file_path"], r["error"] is None) for r in missing] == [(root + "/none", False)]


def test_a_directory_that_cannot_be_listed_is_one_error(spark, tree, tmp_path, monkeypatch):
    from codeloom.plans import ingest as plan
    from codeloom.sources import files

    rows = files.list_files(spark, tree + "/none").collect()
    assert len(rows) == 1 and "FileNotFoundError" in rows[0]["error"]
    lost = spark.createDataFrame([(tree + "/lost", 0, "PermissionError: no")], "file_path string, length bigint, error string")
    listing = files.list_files
    monkeypatch.setattr(plan, "list_files", lambda spark, root: listing(spark, root).unionByName(lost))
    job = ingest(spark, tree, str(tmp_path / "index"), hashed_words(16), buckets=2)
    outcomes = {r["file_path"]: r for r in job.outcomes.collect()}
    row = outcomes[tree + "/lost"]
    assert (row["status"], row["reason"], row["error"]) == ("failed", "error", "PermissionError: no")
    assert job.metrics.first()["files_failed"] == 1 and len(outcomes) == 9


def test_a_file_too_large_for_a_row_is_one_error(spark, tree):
    huge = tree + "/huge.sql"
    with open(huge, "wb") as handle:
        handle.truncate((1 << 31) + 10)  # a hole, no data
    listed = discover_files(spark, tree).where("file_path like '%.sql'")
    rows = {r["file_path"]: r for r in read_files(listed, tree, 1000).select("file_path", "error").collect()}
    assert "2147483658 bytes" in rows[huge]["error"] and rows[tree + "/.git/x.sql"]["error"] is None


def test_buckets_change_and_superseded_folders_go(spark, tree, tmp_path):
    target = str(tmp_path / "index")
    ingest(spark, tree, target, hashed_words(16), buckets=4)
    before = {r["id"] for r in read_index(spark, target).collect()}
    block_index.rebucket(spark, target, 2)
    assert {r["id"] for r in read_index(spark, target).collect()} == before
    path = tree + "/a/A.java"
    assert read_index(spark, target, path).count() == 2 and block_index.has_names(spark, target)
    assert block_index.remove_superseded(spark, target) == []  # too young
    gone = block_index.remove_superseded(spark, target, 0)
    assert len(gone) == 2 and {g.split("/")[0] for g in gone} == {"data", "names"}
    assert {r["id"] for r in read_index(spark, target).collect()} == before
