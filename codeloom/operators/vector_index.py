"""Approximate search over a table stored by cells, with a recall to aim at.

Directions are grouped into cells around centres that are fitted on a bounded sample;
every row is stored in the cell of its nearest centre, as a partition of the table, so a
search reads the cells it chooses and no others. Which ones these are follows from the
data: the nearest cells give a first k-th hit, and the angle of that hit tells, for each
other cell, how many better hits are to be expected there. The most promising cells are
read next, a few times as many rows each round, until all cells left out are together
expected to hold fewer better hits than the recall allows to miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.vectors import as_matrix, distance_to, matrices, row_distances
from codeloom.operators.search import best_first, metadata_filter, search
from codeloom.session import stage

FIT_BYTES = 64 << 20  # of vectors that centres are fitted on, at most; drawn by hash of the id
FIT_ROUNDS = 15
MOST_CELLS, CENTRE_BYTES = 4096, 32 << 20  # bounds of what tasks and the driver hold of the centres
GROWTH = 3  # times as many rows that a round may read as those before it
PRODUCT_NUMBERS = 4_000_000  # of a product of rows and centres, held at a time
NOWHERE = -1  # the cell of rows whose vector is missing or has no direction
ANGLES = 16  # classes of a cell's angles between its rows and its centre
RECALL = 0.9  # expected share of the true nearest rows; see the README for what is measured

_CENTRES = "cell int, centre array<double>, dimension double"


def _directions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors that have a direction, and which these are."""
    known = np.flatnonzero(~np.asarray(column.is_null()))
    parts = [rows for _, rows in matrices(column.drop_null())]
    rows = np.concatenate(parts) if parts else np.zeros((0, 1))
    length = np.sqrt((rows * rows).sum(axis=1))
    use = np.isfinite(length) & (length > 0)
    return rows[use] / length[use, None], known[use]


def fit_centres(rows: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Centres (unit rows) by Lloyd's rounds on unit ``rows``; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), cells, replace=False)]
    step = max(1, PRODUCT_NUMBERS // cells)
    for _ in range(FIT_ROUNDS):
        sums = np.zeros_like(centres)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            np.add.at(sums, np.argmax(some @ centres.T, axis=1), some)
        length = np.sqrt((sums * sums).sum(axis=1))
        moved = length > 0
        centres = np.where(moved[:, None], sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def effective_dimension(rows: np.ndarray) -> float:
    """In how many directions the rows spread evenly: (sum of variances)^2 / sum of their squares."""
    spread = np.cov(rows.T) if len(rows) > 1 else np.eye(rows.shape[1])
    total = float(np.trace(np.atleast_2d(spread)))
    square = float((np.atleast_2d(spread) ** 2).sum())
    return max(2.0, total * total / square) if square > 0 else 2.0


def _fit(index: DataFrame, cells: int | None) -> DataFrame:
    """Rows ``_CENTRES``, fitted in one task on at most ``FIT_BYTES`` of vectors."""
    size = index.select(F.size("embedding").alias("n")).agg(F.max("n"), F.count_if(F.col("n") > 0)).first()
    width, count = size[0] or 0, size[1] or 0
    if not count or width < 1:
        return index.sparkSession.createDataFrame([], _CENTRES)
    sample = max(1, FIT_BYTES // (8 * width))
    wanted = cells or math.ceil(8 * math.sqrt(count))
    most = max(1, min(MOST_CELLS, CENTRE_BYTES // (8 * width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_directions(batch.column(0))[0] for batch in batches]
        parts = [part for part in parts if len(part)]
        if not parts:
            return
        rows = np.concatenate(parts)
        parts.clear()
        centres = fit_centres(rows, min(wanted, most, len(rows)))
        spread = effective_dimension(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(centres)), pa.int32()),
                pa.array(list(centres), pa.list_(pa.float64())),
                pa.array(np.full(len(centres), spread)),
            ],
            ["cell", "centre", "dimension"],
        )

    drawn = index.where(F.size("embedding") > 0).select("embedding", F.xxhash64("id").alias("draw"), "id")
    few = drawn.orderBy("draw", "id").limit(sample).select("embedding")
    return few.repartition(1).mapInArrow(run, _CENTRES)


def write_vector_index(index: DataFrame, path: str, cells: int | None = None) -> None:
    """Store ``index`` (``id``, ``embedding`` and any other columns) at ``path`` by cells.

    About eight times the square root of the rows many cells, if not given, and at
    most ``MOST_CELLS``. Rows with a missing, empty or zero vector are kept in a
    cell of their own. A failed write leaves no table of cells, so it cannot be read.
    """
    spark = index.sparkSession
    _fit(index, cells).write.parquet(f"{path}/centres")
    centres = spark.read.schema(_CENTRES).parquet(f"{path}/centres")
    held = centres.orderBy("cell").select("centre").collect()  # MOST_CELLS at most
    matrix = np.array([row["centre"] for row in held], dtype=np.float64)

    @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def place(embedding: pa.Array) -> pa.Array:
        cell = np.full(len(embedding), NOWHERE, dtype=np.int32)
        angle = np.zeros(len(embedding))
        if len(matrix):
            rows, which = _directions(embedding)
            step = max(1, PRODUCT_NUMBERS // len(matrix))
            for low in range(0, len(rows), step):
                alike = rows[low : low + step] @ matrix.T
                best = alike.argmax(axis=1)
                cell[which[low : low + step]] = best
                angle[which[low : low + step]] = np.arccos(np.clip(alike[np.arange(len(best)), best], -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

    placed = index.withColumn("__place", place(F.col("embedding")))
    rows = placed.select(*index.columns, F.col("__place.cell").alias("cell"), F.col("__place.angle").alias("angle"))
    # Rebalancing splits a cell that holds very many rows over several tasks and files.
    rows.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")  # an index without rows has no other file
    stored = _stored(spark, path).select("cell", "angle")
    turn = F.least(F.floor(F.col("angle") / math.pi * 2 * ANGLES), F.lit(2 * ANGLES - 1)).cast("int")
    counts = stored.groupBy("cell", turn.alias("turn")).agg(F.count("*").alias("n"), F.avg("angle").alias("angle"))
    told = counts.groupBy("cell").agg(  # 2 * ANGLES classes at most
        F.sum("n").alias("n_rows"), F.collect_list(F.struct("angle", "n")).alias("angles")
    )
    told.join(centres, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class Cells:
    """What a search knows of the stored cells; ``owner`` is the place of the cell a class of angles is of."""

    number: np.ndarray
    n_rows: np.ndarray
    dimension: np.ndarray
    owner: np.ndarray
    angle: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Cells:
        classes = [a for row in rows for a in row["angles"]]
        return cls(
            np.array([row["cell"] for row in rows], dtype=np.int64),
            np.array([row["n_rows"] for row in rows], dtype=np.int64),
            np.array([row["dimension"] for row in rows], dtype=np.float64),
            np.repeat(np.arange(len(rows)), [len(row["angles"]) for row in rows]),
            np.array([a["angle"] for a in classes], dtype=np.float64),
            np.array([a["n"] for a in classes], dtype=np.float64),
        )


def _nearer(
    centre_angle: np.ndarray, kth_angle: float, angle: np.ndarray, count: np.ndarray, dimension: np.ndarray
) -> np.ndarray:
    """Rows of each class of angles expected to lie nearer to the query than ``kth_angle``.

    A row at angle r from the centre, in a direction that is even among
    ``dimension``, has a cosine to the query of cos(c) cos(r) + sin(c) sin(r) x, where
    x is close to normal with variance 1 / (dimension - 1).
    """
    reach = np.sin(centre_angle) * np.sin(angle)
    short = math.cos(kth_angle) - np.cos(centre_angle) * np.cos(angle)
    still = reach <= 1e-12
    hits = np.where(still & (short <= 0), count, 0.0)
    some = np.flatnonzero(~still & (short < reach))
    x = short[some] / reach[some] * np.sqrt((dimension[some] - 1) / 2)
    hits[some] = count[some] * 0.5 * np.fromiter(map(math.erfc, x.tolist()), np.float64, len(x))
    return hits


def expected_hits(centre_angle: float, kth_angle: float, angles: Sequence[tuple[float, int]], dimension: float) -> float:
    """Rows of a cell, given as classes of angles, expected to lie nearer to the query than ``kth_angle``."""
    angle, count = np.array(angles, dtype=np.float64).reshape(-1, 2).T
    return float(_nearer(np.full(len(angle), centre_angle), kth_angle, angle, count, np.full(len(angle), dimension)).sum())


def next_cells(cells: Cells, centre_angle: np.ndarray, read: set[int], kth_angle: float, limit: int, recall: float) -> list[int]:
    """The cells to read next, most promising first; none if few enough hits are expected in the rest."""
    done = np.isin(cells.number, list(read))
    rows = (GROWTH - 1) * int(cells.n_rows[done].sum())
    use = np.flatnonzero(~done[cells.owner])
    owner = cells.owner[use]
    hits = _nearer(centre_angle[owner], kth_angle, cells.angle[use], cells.count[use], cells.dimension[owner])
    yields = np.bincount(owner, hits, len(cells.number))
    left, allowed = float(yields.sum()), (1 - recall) * limit
    chosen = []
    for at in np.lexsort((cells.number, -yields / cells.n_rows)).tolist():
        if left <= allowed or rows <= 0:
            break
        if done[at]:
            continue
        chosen.append(int(cells.number[at]))
        left -= yields[at]
        rows -= int(cells.n_rows[at])
    return chosen


def first_cells(cells: Cells, centre_angle: np.ndarray, rows: int) -> list[int]:
    """The nearest cells that hold so many rows."""
    chosen = []
    for at in np.argsort(centre_angle, kind="stable").tolist():
        if rows <= 0:
            break
        chosen.append(int(cells.number[at]))
        rows -= int(cells.n_rows[at])
    return chosen


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_rows(spark: SparkSession, path: str, cells: Sequence[int] | None = None) -> DataFrame:
    """The stored rows, of some cells only if these are given."""
    rows = _stored(spark, path)
    if cells is not None:
        rows = rows.where(F.col("cell").isin(list(cells)))
    return rows.drop("cell", "angle")


def _angle(distance: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


def index_search(
    spark: SparkSession,
    path: str,
    query: Sequence[float],
    limit: int,
    recall: float = RECALL,
    language: str | None = None,
    node_type: str | None = None,
) -> DataFrame:
    """The nearest rows as :func:`codeloom.operators.search.search` gives them, ``recall`` of them as expected.

    A few scans of ids and vectors of the cells chosen, and one of these cells
    for the rows. A query without a direction, and an index in which fewer rows
    than wanted pass the filters, are searched exactly.
    """
    table = spark.read.parquet(f"{path}/cells").where(F.col("cell") != NOWHERE)
    apart = distance_to(query)(F.col("centre"))
    # Numbers about MOST_CELLS cells at most; the centres themselves stay in tasks.
    told = table.select("cell", "n_rows", "angles", "dimension", _angle(apart).alias("centre_angle")).orderBy("cell").collect()
    whole = metadata_filter(read_rows(spark, path), language, node_type)
    probe = np.asarray(query, dtype=np.float64)
    if not told or not np.isfinite(probe).all() or not probe.any():
        return search(whole, query, limit)
    cells, angle = Cells.of(told), np.array([c["centre_angle"] for c in told])
    read: set[int] = set()
    new, hits = first_cells(cells, angle, 4 * limit), []
    while new:
        read.update(new)
        near = metadata_filter(read_rows(spark, path, new), language, node_type)
        found = search(near.select("id", "embedding"), query, limit).collect()  # ``limit`` rows
        hits = sorted([*hits, *((r["score"], r["id"]) for r in found)])[:limit]
        if len(hits) < limit:
            new = [c for c in cells.number.tolist() if c not in read]
        else:
            new = next_cells(cells, angle, read, math.acos(max(-1.0, min(1.0, 1 - hits[-1][0]))), limit, recall)
    if len(hits) < limit:
        return search(whole, query, limit)
    return search(metadata_filter(read_rows(spark, path, sorted(read)), language, node_type), query, limit)


def index_search_batch(
    spark: SparkSession, path: str, queries: DataFrame, limit: int, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, id, score`` of the nearest stored rows of many queries.

    ``queries(query_id, embedding)``. Round by round each query is joined with the
    rows of the cells it has chosen, by cell number, so neither queries nor rows
    pass through the driver. A query without a direction finds nothing here.
    """
    table = spark.read.parquet(f"{path}/cells").where(F.col("cell") != NOWHERE)
    told = table.select("cell", "n_rows", "angles", "dimension", "centre").orderBy("cell").collect()  # CENTRE_BYTES at most
    centres = np.array([c["centre"] for c in told], dtype=np.float64)
    cells = Cells.of(told)
    every = cells.number.tolist()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells read so far, and those to read next, of each query."""
        for batch in batches:
            read, kth = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            new: list[list[int]] = [[] for _ in read]
            rows, which = _directions(batch.column(1))
            for row, at in zip(rows if every else [], which.tolist(), strict=bool(every)):
                angle = np.arccos(np.clip(centres @ row, -1, 1))
                if not read[at]:
                    new[at] = first_cells(cells, angle, 4 * limit)
                elif kth[at] is None:  # fewer rows met than wanted
                    new[at] = [c for c in every if c not in set(read[at])]
                else:
                    angle_of_kth = math.acos(max(-1.0, min(1.0, 1 - kth[at])))
                    new[at] = next_cells(cells, angle, set(read[at]), angle_of_kth, limit, recall)
            both = [old + more for old, more in zip(read, new, strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(both, kind), pa.array(new, kind)], ["query_id", "embedding", "read", "new"]
            )

    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    kind = f"query_id {types['query_id']}, embedding {types['embedding']}, read array<int>, new array<int>"
    rows = _stored(spark, path).select("id", "embedding", "cell")
    order = Window.partitionBy("query_id").orderBy(*best_first())
    asked = queries.select("query_id", "embedding").withColumn("read", F.array().cast("array<int>"))
    asked, hits = asked.withColumn("kth", F.lit(None).cast("double")), None
    while True:
        state = stage(asked.mapInArrow(extend, kind), "probes")
        probes = state.select("query_id", F.col("embedding").alias("probe"), F.explode("new").alias("cell"))
        if hits is not None and probes.isEmpty():
            return hits.select("query_id", "rank", "id", "score")
        scored = rows.join(probes, "cell").select("query_id", "id", _pair_distance("embedding", "probe").alias("score"))
        found = scored if hits is None else hits.select("query_id", "id", "score").unionByName(scored)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        hits = stage(ranked, "hits")
        kth = hits.where(F.col("rank") == limit).select("query_id", F.col("score").alias("kth"))
        asked = state.drop("new").join(kth, "query_id", "left").select("query_id", "embedding", "read", "kth")


@F.arrow_udf(T.DoubleType())
def _pair_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    parts, step = [], max(1, 1_000_000 // max(1, len(a[0]) if len(a) else 1))
    for low in range(0, len(a), step):
        parts.append(row_distances(as_matrix(a.slice(low, step)), as_matrix(b.slice(low, step))))
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64(), from_pandas=False)
