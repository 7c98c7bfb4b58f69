import glob
import os
import time
import zipfile

import pytest
from codeloom.operators.embed import hashed_words
from codeloom.plans import ingest as plan
from codeloom.plans.ingest import ingest
from codeloom.queries import registry
from codeloom.session import settings, work_dir
from codeloom.sources import block_index, files
from codeloom.sources.block_index import read_index
from codeloom.sources.files import check_root, discover_files, list_files, read_files
from test_ingest import TREE, statuses, tree, write  # noqa: F401


def pack(place, members):
    os.makedirs(os.path.dirname(place), exist_ok=True)
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in members.items():
            archive.writestr(path, text)


@pytest.fixture()
def packed(tmp_path):
    """The files of ``tree`` in archives at several depths, beside one loose file."""
    root, names = str(tmp_path / "zips"), sorted(TREE)
    pack(f"{root}/one.zip", {n: TREE[n] for n in names[:4]})
    pack(f"{root}/.sub/dir.zip/Two.ZIP", {n: TREE[n] for n in names[4:]} | {"inner.zip": "x", "empty/": ""})
    write(root, {"loose.sql": "select 1"})
    return root


def inside(path, root):
    return path.removeprefix(f"{root}/one.zip/").removeprefix(f"{root}/.sub/dir.zip/Two.ZIP/")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_archives_are_listed_and_read_like_folders(spark, tree, packed, scheme, monkeypatch):  # noqa: F811
    if scheme:  # through a handle of pyarrow
        monkeypatch.setattr(files, "mounted_path", lambda root: None)
    root, base = f"zip:{scheme}{packed}", scheme + packed
    assert files._has_handle(root)
    listed = discover_files(spark, root)
    lengths = {inside(r["file_path"], base): r["length"] for r in listed.collect()}
    assert lengths == {n: len(t) for n, t in TREE.items() if n not in ("n.txt", ".java")}
    for tasks in (1, 3):
        contents = read_files(listed, root, tasks * files.TASK_BYTES).collect()
        assert {inside(r["file_path"], base): bytes(r["content"]).decode() for r in contents} == {n: TREE[n] for n in lengths}
    if not scheme:
        assert check_root(spark, root) and not check_root(spark, root + "/none")


def test_a_store_holds_archives_too(packed):
    root = "file://" + packed
    store = files._Packed(files._Store(root))
    assert store.read(f"{root}/one.zip/C.java").decode() == TREE["C.java"]
    assert store.size(f"{root}/.sub/dir.zip/Two.ZIP/e.html") == len(TREE["e.html"])


def test_archives_give_the_outcomes_of_the_files(spark, tree, packed, tmp_path):  # noqa: F811
    loose = ingest(spark, tree, str(tmp_path / "a"), hashed_words(16), buckets=2)
    job = ingest(spark, "zip:" + packed, str(tmp_path / "b"), hashed_words(16), buckets=2)
    status = {inside(r["file_path"], packed): (r["status"], r["blocks_extracted"]) for r in job.outcomes.collect()}
    # Of the equal C.java and copy/C.java the smaller path wins, which an archive's name is part of.
    assert {status.pop("C.java")[0], status.pop("copy/C.java")[0]} == {"success", "skipped"}
    expected = {os.path.relpath(r["file_path"], tree): (r["status"], r["blocks_extracted"]) for r in loose.outcomes.collect()}
    assert status == {n: s for n, s in expected.items() if not n.endswith("C.java")}
    assert job.metrics.drop("elapsed_seconds").first() == loose.metrics.drop("elapsed_seconds").first()
    again = ingest(spark, "zip:" + packed, str(tmp_path / "b"), hashed_words(16), buckets=2)
    assert again.metrics.first()["files_processed"] == 0


def test_a_broken_archive_or_member_fails_alone(spark, tmp_path):
    root = str(tmp_path / "zips")
    pack(f"{root}/good.zip", {"a.sql": "select 1", "b.sql": "select 'abcdefgh' from b"})
    with zipfile.ZipFile(f"{root}/good.zip") as archive:
        info = archive.getinfo("b.sql")
    with open(f"{root}/good.zip", "r+b") as handle:
        handle.seek(info.header_offset + 30 + len("b.sql"))
        handle.write(b"\xff\xff\xff\xff")
    write(root, {"broken.zip": "no archive"})
    with pytest.warns(UserWarning), zipfile.ZipFile(f"{root}/twice.zip", "w") as archive:
        archive.writestr("t.sql", "select 1 from before")
        archive.writestr("t.sql", "select 2 from after")
    job = ingest(spark, "zip:" + root, str(tmp_path / "i"), hashed_words(16), buckets=2)
    assert {k: v[0] for k, v in statuses(job, root).items()} == {
        "broken.zip": "failed", "good.zip/a.sql": "success", "good.zip/b.sql": "failed", "twice.zip/t.sql": "success"
    }
    errors = {os.path.relpath(r["file_path"], root): r["error"] for r in job.outcomes.collect()}
    assert "BadZipFile" in errors["broken.zip"] and errors["good.zip/b.sql"]
    assert {r["content"] for r in read_index(spark, str(tmp_path / "i")).collect()} == {"select 1", "select 2 from after"}
    gone = spark.createDataFrame([(f"{root}/good.zip/gone.sql", 3), (f"{root}/none.zip/a.sql", 3)], "file_path string, length bigint")
    assert all("FileNotFoundError" in r["error"] for r in read_files(gone, "zip:" + root).collect())


def shuffle_files(spark):
    local = spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())
    return {f for top in local for f in glob.glob(f"{top}/**/shuffle_*", recursive=True)}


def test_blocks_and_shuffles_are_gone_when_the_index_is_written(spark, tree, tmp_path, monkeypatch):  # noqa: F811
    before, stages = shuffle_files(spark), []

    def watched(*arguments):
        until = time.monotonic() + 20  # Spark removes them without waiting
        while (left := shuffle_files(spark) - before) and time.monotonic() < until:
            time.sleep(0.1)
        assert not left
        here = f"{work_dir(spark).removeprefix('file:')}/run-*/stage-*"
        stages.extend(os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(here))
        block_index.write_blocks(*arguments)

    monkeypatch.setattr(plan, "write_blocks", watched)
    job = ingest(spark, tree, str(tmp_path / "i"), hashed_words(16), buckets=2)
    assert job.metrics.first()["blocks_inserted"] == read_index(spark, str(tmp_path / "i")).count()
    assert "stage-vectors" in stages and "stage-blocks" not in stages and "stage-elected" not in stages


def test_the_setting_of_the_session_comes_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in (None, "false"):
        if before is not None:
            spark.conf.set(name, before)
        with pytest.raises(KeyError), settings(spark, {name: "true"}):
            assert spark.conf.get(name) == "true"
            raise KeyError
        assert spark.conf.get(name) == "false"
    spark.conf.unset(name)


def test_ids_are_made_behind_the_shuffle(spark, tmp_path, monkeypatch):
    seen, commit = [], block_index._commit

    def watched(rows, *others):
        seen.append({r["file_path"]: r["id"] for r in rows.collect()})
        commit(rows, *others)

    monkeypatch.setattr(block_index, "_commit", watched)
    target = str(tmp_path / "i")
    rows = spark.createDataFrame([("a.sql", "h", 0, "select 1")], "file_path string, file_sha256 string, ordinal int, content string")
    block_index.write_blocks(spark, target, rows, buckets=1)
    block_index.write_blocks(spark, target, rows.replace("a.sql", "b.sql"))
    first, second = (r["id"] for r in read_index(spark, target).orderBy("file_path").collect())
    assert seen == [{"a.sql": None}, {"a.sql": first, "b.sql": None}] and len({first, second}) == 2
    again = rows.unionByName(rows.replace("a.sql", "b.sql")).orderBy("file_path").select(block_index.block_id())
    assert [r[0] for r in again.collect()] == [first, second]


def test_many_rows_are_shuffled_part_by_part(spark, tree, tmp_path, monkeypatch):  # noqa: F811
    assert [block_index.parts_for(n * block_index.ROWS_AT_ONCE, 8) for n in (0, 1, 1.5, 3, 100)] == [1, 1, 2, 4, 8]
    assert block_index.parts_for(10**12, 7) == 1
    written, plans, write_rows = [], [], block_index._write_rows

    def watched(rows, *others):
        written.append({r["bucket"] for r in rows.select("bucket").collect()})
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write_rows(rows, *others)

    whole, target = str(tmp_path / "whole"), str(tmp_path / "parts")
    ingest(spark, tree, whole, hashed_words(16), buckets=8)
    monkeypatch.setattr(block_index, "_write_rows", watched)
    monkeypatch.setattr(block_index, "ROWS_AT_ONCE", 4)
    metrics = ingest(spark, tree, target, hashed_words(16), buckets=8).metrics.first()
    assert metrics["blocks_inserted"] == 10 and len(written) == 4  # of two buckets each
    assert all("PartitionFilters: [isnotnull(part" in plan for plan in plans)
    assert all(not a & b for a in written for b in written if a is not b)
    assert read_index(spark, target).exceptAll(read_index(spark, whole)).isEmpty()
    assert read_index(spark, target).count() == 10
    # A second write in parts keeps the rows of other files and replaces those of its own.
    write(tree, {f"n{i}.sql": f"select {i}" for i in range(12)} | {"C.java": "class C2 { }"})
    ingest(spark, tree, target, hashed_words(16), buckets=8)
    ingest(spark, tree, whole, hashed_words(16), buckets=8)
    assert len(written) == 12 and read_index(spark, target).count() == read_index(spark, whole).count() >= 22
    assert read_index(spark, target).exceptAll(read_index(spark, whole)).isEmpty()
    assert block_index.has_names(spark, target)


def test_the_job_does_not_hold_a_block_of_the_disk_for_each_file(spark, monkeypatch):
    held = []

    def watched(session, root, *others, **options):
        folder = root.removeprefix("zip:")
        held.extend(os.lstat(os.path.join(d, n)).st_blocks * 512 for d, _, names in os.walk(folder) for n in names)
        listed = list_files(session, root)
        assert listed.where("error is null and length > 0").count() == listed.count() == 410
        return ingest(session, root, *others, **options)

    monkeypatch.setattr(registry, "ingest", watched)
    trees = glob.glob(f"{work_dir(spark)}/tree-*")
    assert registry.QUERIES["ingest_job"](spark, "/root/testdata/sf0.001").first()["files_discovered"] == 410
    assert sum(held) < 410 * 1024 and glob.glob(f"{work_dir(spark)}/tree-*") == trees


def test_a_task_fills_several_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "MEMBERS", 4)
    rows = spark.range(22).selectExpr("concat('d/', id, '.sql') file_path", "concat('é', id) text").coalesce(2)
    for _ in range(2):  # a second attempt puts the same archives in the same places
        registry._write_archives(rows, str(tmp_path / "z"))
    assert len(os.listdir(tmp_path / "z")) == 6
    read = read_files(discover_files(spark, f"zip:{tmp_path}/z"), f"zip:{tmp_path}/z").collect()
    assert {os.path.basename(r["file_path"]): bytes(r["content"]).decode() for r in read} == {f"{i}.sql": f"é{i}" for i in range(22)}
