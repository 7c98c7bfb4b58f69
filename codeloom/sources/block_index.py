"""The block index: one Parquet table, replaced file by file.

Rows are partitioned by a hash bucket of ``file_path``. A write puts only the
buckets it touches into a new folder and then publishes a small manifest that
names, for each bucket, the folder holding its current rows. Publishing is
one atomic rename: readers see the old or the new state, and a failed write
leaves the old one.

Beside each folder of rows lies one of names: a slim row for each name a block
answers to, with what the block refers to, by bucket of the name. It is written and
published with its rows, and expansions read it instead of them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.deps import SLIM, named_rows
from codeloom.schema import BLOCK_INDEX, conform

# Buckets of a new index; size it so that a bucket holds about a gigabyte.
BUCKETS = 256
# Buckets by name, within each of these, of the table of names.
NAME_BUCKETS = 16
_NAMES = (
    "id string, file_path string, start_line int, ordinal int, injects array<string>, implements array<string>, "
    "extends string, calls_components array<string>, via int, name string"
)

# Rows that a write of many shuffles at a time.
ROWS_AT_ONCE = 8_000_000


def parts_for(rows: int, buckets: int = BUCKETS) -> int:
    """In how many parts to write so many rows: a power of two that divides the number of buckets."""
    parts = 1
    while rows > parts * ROWS_AT_ONCE and buckets % (2 * parts) == 0:
        parts *= 2
    return parts


def part_of(path: Column, parts: int) -> Column:
    """The part of a file's rows; a bucket is in one part if ``parts`` divides their number."""
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _with_bucket(rows: DataFrame, state: dict) -> DataFrame:
    return rows.withColumn("bucket", bucket_of(F.col("file_path"), state["buckets"]))


def block_id() -> Column:
    """Same id for the same block of the same file content, however often it is computed."""
    return F.sha2(F.concat_ws("\u0000", "file_path", "file_sha256", F.col("ordinal").cast("string")), 256)


def _fs(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _manifest(spark: SparkSession, path: str, buckets: int = BUCKETS) -> dict:
    """Newest published state: version, bucket count and folder of each bucket."""
    fs, folder = _fs(spark, f"{path}/_manifest")
    if not fs.exists(folder):
        return {"version": 0, "buckets": buckets, "folders": {}}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    newest = max(n for n in names if n.endswith(".json"))
    text = spark.read.text(f"{path}/_manifest/{newest}", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    fs, draft = _fs(spark, f"{path}/_manifest/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    _, final = _fs(spark, f"{path}/_manifest/{state['version']:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError("another writer published this index version first; run the job again")


def index_exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifest(spark, path)["folders"])


def read_index(spark: SparkSession, path: str, file_path: str | None = None) -> DataFrame:
    """Current rows with the typed block schema; with ``file_path`` only its bucket's."""
    state = _manifest(spark, path)
    if file_path is None:
        return _read(spark, path, state, list(state["folders"]))
    home = spark.range(1).select(bucket_of(F.lit(file_path), state["buckets"])).first()[0]
    return _read(spark, path, state, [str(home)]).where(F.col("file_path") == file_path)


def _read(spark: SparkSession, path: str, state: dict, buckets: list[str]) -> DataFrame:
    folders = state["folders"]
    places = [f"{path}/{folders[b]}/bucket={b}" for b in buckets if b in folders]
    if not places:
        return spark.createDataFrame([], BLOCK_INDEX)
    return spark.read.schema(BLOCK_INDEX).parquet(*places)


def _commit(
    rows: DataFrame | None, path: str, state: dict, touched: list[int], spark: SparkSession, parts: int = 1
) -> None:
    folder = f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
    folders = {b: f for b, f in state["folders"].items() if int(b) not in set(touched)}
    if rows is not None:
        for part in range(parts):
            _write_rows(rows if parts == 1 else rows.where(F.col("part") == part).drop("part"), path, folder)
        fs, where = _fs(spark, f"{path}/{folder}")
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.startswith("bucket="):
                folders[name.removeprefix("bucket=")] = folder
    _publish(
        spark,
        path,
        {"version": state["version"] + 1, "buckets": state["buckets"], "folders": folders},
    )


def _write_rows(rows: DataFrame, path: str, folder: str) -> None:
    """Add rows, and their names, to a folder that is not published yet."""
    # Rebalancing splits a bucket that holds too much and merges small ones; sorting lets a
    # lookup by file skip row groups. Ids of new rows are made behind it: digests do not get
    # smaller in a shuffle. A bloom filter has a megabyte unless its size follows the values.
    (
        rows.hint("rebalance", F.col("bucket"))
        .withColumn("id", F.coalesce("id", block_id()))
        .sortWithinPartitions("bucket", "file_path", "start_line", "ordinal")
        .write.mode("append")
        .partitionBy("bucket")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.enabled#class_name", "true")
        .option("parquet.bloom.filter.enabled#component_name", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(f"{path}/{folder}")
    )
    slim = rows.withColumn("id", F.coalesce("id", block_id())).select(*SLIM, "bucket")
    (
        named_rows(slim, "bucket")
        .withColumn("name_bucket", name_bucket(F.col("name")))
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "name_bucket", "name")
        .write.mode("append")
        .partitionBy("bucket", "name_bucket")
        .option("compression", "zstd")
        .parquet(f"{path}/{_names_of(folder)}")
    )


def _names_of(folder: str) -> str:
    return folder.replace("data/", "names/", 1)


def name_bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(NAME_BUCKETS)).cast("int")


def read_names(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored name rows that may answer to ``wanted(via, name)``: those of the names' buckets."""
    folders = _manifest(spark, path)["folders"]
    numbers = [r[0] for r in wanted.select(name_bucket(F.col("name"))).distinct().collect()]  # NAME_BUCKETS at most
    places = []
    for folder in sorted(set(folders.values())):
        fs, every = _fs(spark, f"{path}/{_names_of(folder)}/bucket=*/name_bucket=*")
        for status in fs.globStatus(every) or []:
            place = status.getPath()
            home, number = (p.getName().split("=")[1] for p in (place.getParent(), place))
            if folders.get(home) == folder and int(number) in numbers:
                places.append(place.toString())
    if not places:
        return spark.createDataFrame([], _NAMES)
    return spark.read.schema(_NAMES).parquet(*places)


def has_names(spark: SparkSession, path: str) -> bool:
    """Whether every folder of rows has one of names; an index written before names were kept has none."""
    folders = set(_manifest(spark, path)["folders"].values())
    return bool(folders) and all(_fs(spark, path)[0].exists(_fs(spark, f"{path}/{_names_of(f)}")[1]) for f in folders)


# Rows whose paths and ids reach the scan as filters.
INLINE_ROWS = 200


def read_rows(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The current rows named by ``keys(file_path, id)``, which should be staged.

    Only the buckets of these files are read; the paths and ids of a few rows are
    pushed into the scan as well.
    """
    state = _manifest(spark, path)
    homes = keys.select(bucket_of(F.col("file_path"), state["buckets"])).distinct().collect()  # one row per bucket
    rows = _read(spark, path, state, [str(r[0]) for r in homes])
    few = keys.select("file_path", "id").limit(INLINE_ROWS + 1).collect()
    if len(few) <= INLINE_ROWS:
        return rows.where(F.col("file_path").isin([r[0] for r in few]) & F.col("id").isin([r[1] for r in few]))
    return rows.join(keys.select("file_path", "id"), ["file_path", "id"], "left_semi").select(rows.columns)


def write_blocks(
    spark: SparkSession, path: str, new_blocks: DataFrame, buckets: int = BUCKETS, parts: int = 1
) -> None:
    """Replace all rows of every file in ``new_blocks``; other files keep theirs.

    ``new_blocks`` should be staged: it is read twice. A file without blocks is
    not in it, so its old rows stay. With several ``parts`` the rows have theirs as
    ``part`` (:func:`part_of`) and are shuffled one part after the other; staged
    by it they are not read more often.
    """
    state = _manifest(spark, path, buckets)
    more = ["part"] if parts > 1 else []
    fresh = _with_bucket(conform(new_blocks.drop("id"), BLOCK_INDEX, *more), state)
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # one row per bucket
    if not touched:
        return
    if state["folders"].keys() & {str(b) for b in touched}:
        old = _read(spark, path, state, [str(b) for b in touched])
        if more:
            old = old.withColumn("part", part_of(F.col("file_path"), parts))
        replaced = fresh.select("file_path").distinct()
        fresh = _with_bucket(old.join(replaced, "file_path", "left_anti"), state).unionByName(fresh)
    _commit(fresh, path, state, touched, spark, parts)


def purge(spark: SparkSession, path: str, prefix: str | None = None) -> None:
    """Drop all rows, or those whose path starts with ``prefix`` (taken literally)."""
    state = _manifest(spark, path)
    if prefix is None:
        _commit(None, path, state, [int(b) for b in state["folders"]], spark)
        return
    rows = _with_bucket(_read(spark, path, state, list(state["folders"])), state)
    doomed = F.startswith(F.col("file_path"), F.lit(prefix))
    touched = [r[0] for r in rows.where(doomed).select("bucket").distinct().collect()]
    if touched:
        kept = _read(spark, path, state, [str(b) for b in touched]).where(~doomed)
        _commit(_with_bucket(kept, state), path, state, touched, spark)


def rebucket(spark: SparkSession, path: str, buckets: int) -> None:
    """Write all rows again in another number of buckets and publish that as one new state."""
    state = _manifest(spark, path)
    rows = _read(spark, path, state, list(state["folders"]))
    empty = {**state, "buckets": buckets, "folders": {}}
    _commit(_with_bucket(rows, empty), path, empty, [], spark)


def remove_superseded(spark: SparkSession, path: str, older_than: float = 86_400) -> list[str]:
    """Delete the folders no current state names, once they are ``older_than`` seconds old.

    Younger ones may belong to a write that is not published yet, or be read by a
    query that began before the last one. Returns the folders deleted.
    """
    used = set(_manifest(spark, path)["folders"].values())
    used |= {_names_of(folder) for folder in used}
    now, gone = time.time(), []
    for kind in ("data", "names"):
        fs, where = _fs(spark, f"{path}/{kind}")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            folder = f"{kind}/{status.getPath().getName()}"
            if folder not in used and now - status.getModificationTime() / 1000 >= older_than:
                fs.delete(status.getPath(), True)
                gone.append(folder)
    return sorted(gone)
