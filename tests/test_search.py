import math

import numpy as np
import pytest
from codeloom.functions.vectors import cosine_distance, distance_to
from codeloom.operators import catalog, search as near
from codeloom.operators.deps import expand_dependencies
from codeloom.operators.embed import client_embedder, embed_blocks, embed_query, hashed_words
from codeloom.plans.search_code import _fetched, _ranking, check_search, search_code
from codeloom.schema import BLOCK_INDEX, conform
from pyspark.sql import functions as F

VECTORS = {
    "a": [1.0, 0.0],
    "b": [0.0, 1.0],
    "c": [-2.0, 0.0],
    "d": [0.0, 0.0],
    "e": None,
    "f": [3.0, 0.0],
}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "id string, embedding array<float>").repartition(3)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_distance_forms_agree(spark, vectors):
    probe = F.array(F.lit(1.0), F.lit(0.0))
    rows = vectors.select(
        "id",
        cosine_distance(F.col("embedding"), probe).alias("x"),
        distance_to([1.0, 0.0])(F.col("embedding")).alias("y"),
    ).collect()
    want = {"a": 0.0, "b": 1.0, "c": 2.0, "d": math.nan, "e": None, "f": 0.0}
    for row in rows:
        assert same(row["x"], want[row["id"]]) and same(row["y"], want[row["id"]])


def test_order_of_ties_zero_and_missing_vectors(vectors):
    assert [r["id"] for r in near.search(vectors, [1.0, 0.0], 10).collect()] == list("afbcde")
    queries = vectors.where("id = 'a'").select(F.col("id").alias("query_id"), "embedding")
    batch = near.search_batch(vectors, queries, 6).orderBy("rank").collect()
    assert [r["id"] for r in batch] == list("afbcde")
    assert [r["rank"] for r in batch] == [1, 2, 3, 4, 5, 6]


def test_batch_in_groups_equals_single_searches(spark, vectors, monkeypatch):
    monkeypatch.setattr(near, "QUERY_BYTES", 100)  # several groups of queries
    rng = np.random.default_rng(1)
    data = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    index = spark.createDataFrame(data, "id bigint, embedding array<float>").where("id >= 0")
    queries = index.where("id < 9 and aggregate(embedding, 0D, (a, x) -> a + x * x) > 0").select(
        F.col("id").alias("query_id"), "embedding"
    )
    found = near.search_batch(index, queries, 7).collect()
    for q in queries.collect():
        want = [r["id"] for r in near.search(index, q["embedding"], 7).collect()]
        got = sorted((r["rank"], r["id"]) for r in found if r["query_id"] == q["query_id"])
        assert [i for _, i in got] == want


def test_filters_and_plan(spark):
    index = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", F.lit("en").alias("language"), F.lit("x").alias("node_type")
    )
    assert near.search(index, [1.0] * 64, 5, "fr").count() == 0
    assert near.search(index, [1.0] * 64, 5, "en", "x").count() == 5
    plan = near.search(index, [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Cartesian" not in plan


def test_approximate_search_recall(spark):
    index = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    signed = near.with_signature(index, 6, 64).cache()
    hits = total = 0
    for row in index.limit(10).collect():
        exact = {r["id"] for r in near.search(index, row["embedding"], 5).collect()}
        approx = [r["id"] for r in near.ann_search(signed, row["embedding"], 5, 6, flips=4).collect()]
        assert approx[0] == row["id"]
        hits, total = hits + len(exact & set(approx)), total + 5
    # 16 of 64 signatures are probed; what is found must be far more than that share.
    assert hits / total > 1.5 * 16 / 64
    # With every bit free the search is exact.
    full = near.ann_search(signed, row["embedding"], 5, 6, flips=6).collect()
    assert {r["id"] for r in full} == exact


def test_hashed_words(spark):
    rows = spark.createDataFrame([("A a b",), ("",), ("!",)], "content string")
    out = [r["embedding"] for r in embed_blocks(rows, hashed_words(16)).collect()]
    assert all(len(v) == 16 for v in out)
    assert sorted(round(x * x, 3) for x in out[0] if x) == [0.2, 0.8]
    assert not any(out[1]) and not any(out[2])


def test_client_embedder_isolates_failures(spark):
    def factory():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return [[float(len(t)), 1.0] for t in texts]

        return call

    rows = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "content string").coalesce(1)
    out = {r["content"]: r for r in embed_blocks(rows, client_embedder(factory)).collect()}
    assert out["a"]["embedding"] == [1.0, 1.0] and out["a"]["embed_error"] is None
    assert out["bad"]["embedding"] is None and "refused" in out["bad"]["embed_error"]
    assert out["ccc"]["embedding"] == [3.0, 1.0]


def test_embed_query(spark):
    with pytest.raises(ValueError):
        embed_query(spark, "", hashed_words(8))
    assert embed_query(spark, "   ", hashed_words(8)) == [0.0] * 8


@pytest.mark.parametrize("query,limit,depth", [("", 10, 1), ("x", 0, 1), ("x", 51, 1), ("x", 10, 0), ("x", 10, 4)])
def test_bad_arguments(query, limit, depth):
    with pytest.raises(ValueError):
        check_search(query, limit, depth)


@pytest.mark.parametrize("query,limit,depth", [(" ", 1, 1), ("x", 50, 3)])
def test_good_arguments(query, limit, depth):
    check_search(query, limit, depth)


def index_of(spark, rows):
    fields = ["id", "file_path", "start_line", "content", "class_name", "component_name", "injects", "extends", "implements", "calls_components"]
    kinds = "id string, file_path string, start_line int, content string, class_name string, component_name string, injects array<string>, extends string, implements array<string>, calls_components array<string>"
    data = [tuple(r.get(f) for f in fields) for r in rows]
    frame = spark.createDataFrame(data, kinds).withColumn("ordinal", F.lit(0)).withColumn("language", F.lit("java"))
    embedded = embed_blocks(frame, hashed_words(32)).drop("embed_error")
    return conform(embedded, BLOCK_INDEX)


@pytest.fixture(scope="module")
def graph(spark):
    return index_of(
        spark,
        [
            dict(id="1", file_path="a", start_line=10, content="alpha", class_name="A", injects=["B", "Provider<X>"], extends="A"),
            dict(id="2", file_path="b", start_line=2, content="beta", class_name="B", injects=["A"], implements=["Missing", "C"]),
            dict(id="3", file_path="c", start_line=2, content="gamma", class_name="C", calls_components=["K"]),
            dict(id="4", file_path="k", start_line=9, content="delta", component_name="K"),
            dict(id="5", file_path="k", start_line=10, content="epsilon", component_name="K"),
            dict(id="6", file_path="m", start_line=1, content="method"),
            dict(id="7", file_path="b", start_line=1, content="other b", class_name="B"),
            dict(id="8", file_path="x", start_line=1, content="zeta", component_name="pkg.Foo", calls_components=["Foo"]),
        ],
    ).cache()


@pytest.mark.parametrize(
    "seed,depth,want",
    [
        ("1", 1, ["7", "2"]),  # a cycle and a self reference do not come back
        ("1", 2, ["7", "2", "3"]),
        ("1", 3, ["7", "2", "3", "4", "5"]),
        ("6", 3, []),  # methods carry no references
        ("8", 1, []),  # dotted names never match
    ],
)
def test_expansion(graph, seed, depth, want):
    found = expand_dependencies(graph, graph.where(F.col("id") == seed), depth)
    assert [r["id"] for r in found.collect()] == want


def test_search_code_appends_dependencies(graph):
    found = search_code(graph, "alpha", hashed_words(32), limit=1, expand_dependencies=True, dependency_depth=3).collect()
    assert [(r["rank"], r["id"], r["is_dependency"]) for r in found] == [
        (1, "1", False), (2, "7", True), (3, "2", True), (4, "3", True), (5, "4", True), (6, "5", True),
    ]
    assert found[0]["score"] is not None and all(r["score"] is None for r in found[1:])
    assert search_code(graph, "alpha", hashed_words(32), language="none", expand_dependencies=True).count() == 0


def test_catalogue(graph):
    assert [r["start_line"] for r in catalog.get_file_blocks(graph, "k").collect()] == [9, 10]
    assert "embedding" not in catalog.get_file_blocks(graph, "k").columns
    assert catalog.get_file_blocks(graph, "nope").count() == 0
    with pytest.raises(ValueError):
        catalog.get_file_blocks(graph, "")
    files = catalog.list_indexed_files(graph).collect()
    assert [(r["file_path"], r["block_count"]) for r in files] == [("a", 1), ("b", 2), ("c", 1), ("k", 2), ("m", 1), ("x", 1)]
    assert [r["id"] for r in catalog.find_blocks_by_name(graph, ["B", "b"], "class_name").collect()] == ["7", "2"]
    assert catalog.find_blocks_by_name(graph, [], "class_name").count() == 0
    many = [f"N{i}" for i in range(300)] + ["C"]
    assert [r["id"] for r in catalog.find_blocks_by_name(graph, many, "class_name").collect()] == ["3"]


def test_words_of_any_script_have_a_direction(spark):
    from pyspark.sql import functions as F

    from codeloom.operators.embed import hashed_words

    rows = spark.createDataFrame([("日本語 テキスト",), ("código ação",), ("codigo acao",)], "t string")
    vectors = [r[0] for r in rows.select(hashed_words(64)(F.col("t"))).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors)
    assert vectors[1] != vectors[2]


def test_approximate_search_widens_until_the_limit_is_met(spark):
    rows = [(i, "p", [1.0, float(i % 7), -float(i % 5), 0.5]) for i in range(40)]
    index = spark.createDataFrame(rows, "id long, file_path string, embedding array<float>")
    signed = near.with_signature(index, 6, 4)
    for limit in (1, 20, 40, 50):
        found = near.ann_search(signed, [-1.0, -3.0, 4.0, -0.5], limit, 6, flips=0)
        assert found.count() == min(limit, 40)


def test_search_ranks_without_contents_and_fetches_by_id(spark, graph, tmp_path):
    graph.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    ranking = _ranking(index, [1.0] * 32, 3, None, None)
    plan = ranking._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    hits = ranking.collect()
    plan = _fetched(index, hits)._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan and "embedding" not in plan


def test_index_by_cells_reaches_the_recall(spark, tmp_path, monkeypatch):
    """Recall of the ten nearest over all queries with an id divisible by 50, against all rows."""
    from codeloom.operators import vector_index as cells

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    path = str(tmp_path / "cells")
    cells.write_vector_index(rows, path)
    held = rows.collect()
    ids = np.array([r["id"] for r in held])
    vectors = np.array([r["embedding"] for r in held], dtype=np.float64)
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in cells.index_search_batch(spark, path, queries, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    shares = []
    for query in ids[ids % 50 == 0].tolist():
        alike = vectors @ vectors[np.flatnonzero(ids == query)[0]]
        exact = ids[np.lexsort((ids, -np.round(alike, 12)))[:10]].tolist()
        found = [i for _, i, _ in sorted(got[query])]
        assert len(found) == 10 and found[0] == query
        shares.append(len(set(found) & set(exact)) / 10)
    asked, whole = [], cells.read_rows
    monkeypatch.setattr(cells, "read_rows", lambda spark, path, which=None: asked.append(which) or whole(spark, path, which))
    sizes = {r["cell"]: r["n_rows"] for r in spark.read.parquet(f"{path}/cells").collect()}
    read = []
    for number in (0, 350, 1050):
        one = cells.index_search(spark, path, vectors[ids.tolist().index(number)].tolist(), 10)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell#" in plan
        assert {r["id"] for r in one.collect()} == {i for _, i, _ in got[number]}
        read.append(sum(sizes[c] for c in asked[-1]) / sum(sizes.values()))
    share = np.mean(read)
    print(f"recall@10 {np.mean(shares):.3f}, rows read {share:.3f} of all, cells {len(sizes)}")
    assert np.mean(shares) >= 0.9 and share < 0.5 and "TakeOrderedAndProject" in plan


def test_index_by_cells_of_odd_rows(spark, tmp_path):
    from codeloom.operators import vector_index as cells

    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(4).tolist(), "en" if i % 3 else "de", "x") for i in range(200)]
    data += [(200, None, "en", "x"), (201, [0.0] * 4, "en", "x"), (202, data[7][1], "en", "x")]
    index = spark.createDataFrame(data, "id bigint, embedding array<float>, language string, node_type string")
    path = str(tmp_path / "cells")
    cells.write_vector_index(index, path, cells=12)
    assert cells.read_rows(spark, path).count() == 203
    query = data[7][1]
    hits = cells.index_search(spark, path, query, 5).collect()
    assert [r["id"] for r in hits[:2]] == [7, 202]
    exact = [r["id"] for r in near.search(index, query, 50, "de").collect()]
    some = [r["id"] for r in cells.index_search(spark, path, query, 50, language="de").collect()]
    assert len(set(some) & set(exact)) >= 45
    # More than there is, and queries without a direction, are searched exactly.
    assert [r["id"] for r in cells.index_search(spark, path, query, 300).collect()] == [r["id"] for r in near.search(index, query, 300).collect()]
    assert cells.index_search(spark, path, [0.0] * 4, 3).count() == 3
    empty = str(tmp_path / "empty")
    cells.write_vector_index(index.where("id < 0"), empty)
    assert cells.index_search(spark, empty, query, 3).count() == 0


def test_expected_hits_are_those_of_even_directions():
    from codeloom.operators.vector_index import expected_hits

    rng = np.random.default_rng(1)
    rows = rng.standard_normal((20000, 32))
    rows /= np.sqrt((rows**2).sum(axis=1))[:, None]
    centre, query = rows[0], rows[1]
    angle = np.arccos(np.clip(rows @ centre, -1, 1))
    found = (np.arccos(np.clip(rows @ query, -1, 1)) < 1.3).sum()
    apart = float(np.arccos(centre @ query))
    got = expected_hits(apart, 1.3, [(a, 1) for a in angle.tolist()], 32)
    assert 0.7 < got / found < 1.4


def test_stored_names_expand_like_the_rows(spark, tmp_path):
    from functools import partial

    from codeloom.operators.deps import reach, reach_stored
    from codeloom.plans.search_code import search_stored
    from codeloom.session import stage
    from codeloom.sources import block_index

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        name = lambda: f"N{rng.integers(0, 120)}"  # noqa: B023, E731
        rows.append((f"f{i % 40}.java", i, "class_declaration", "java", f"text {i}", i, i, "h", [name()], name() if i % 2 else None, f"N{i % 150}" if i % 3 else None, f"K{i % 9}" if i % 4 == 0 else None, [f"K{rng.integers(0, 9)}"] if i % 5 == 0 else None))
    frame = spark.createDataFrame(
        rows,
        "file_path string, ordinal int, node_type string, language string, content string, start_line int, end_line int, "
        "file_sha256 string, injects array<string>, extends string, class_name string, component_name string, calls_components array<string>",
    )
    path = str(tmp_path / "index")
    blocks = embed_blocks(conform(frame, BLOCK_INDEX).drop("embedding", "id"), hashed_words(16)).drop("embed_error")
    blocks = stage(blocks, "blocks")
    block_index.write_blocks(spark, path, blocks, buckets=4)
    # A second write replaces files and their names.
    block_index.write_blocks(spark, path, blocks.where("file_path in ('f1.java', 'f2.java')").where("ordinal < 100"), buckets=4)
    index = block_index.read_index(spark, path)
    assert index.count() == 290 and block_index.has_names(spark, path)
    seeds = index.where("file_path = 'f3.java'")
    for depth in (1, 2, 3):
        want = {tuple(r) for r in reach(index, seeds, depth).collect()}
        got = reach_stored(partial(block_index.read_names, spark, path), seeds, depth)
        assert {tuple(r) for r in got.collect()} == want
    wanted = spark.createDataFrame([(0, "N7")], "via int, name string")
    number = wanted.select(block_index.name_bucket(F.col("name"))).first()[0]
    read = block_index.read_names(spark, path, wanted).inputFiles()
    assert read and all("/names/" in f and f"/name_bucket={number}/" in f for f in read)
    keys = stage(got.select("file_path", "id").limit(3), "keys")
    fetched = block_index.read_rows(spark, path, keys)
    assert fetched.count() == 3 and "In(file_path" in fetched._jdf.queryExecution().executedPlan().toString()
    plain_rows = search_code(index, "text 5", hashed_words(16), limit=4, expand_dependencies=True, dependency_depth=2).collect()
    stored = search_stored(spark, path, "text 5", hashed_words(16), limit=4, expand_dependencies=True, dependency_depth=2, metadata=True)
    stored_rows = stored.collect()
    assert [(r["rank"], r["id"], r["is_dependency"]) for r in stored_rows] == [(r["rank"], r["id"], r["is_dependency"]) for r in plain_rows]
    assert '"node_type":"class_declaration"' in stored_rows[0]["metadata"]


def test_centres_are_fitted_in_bounded_memory():
    """No product of all rows and all centres is held, and blocks of rows give the same centres."""
    import tracemalloc

    from codeloom.operators import vector_index as cells

    rows = np.random.default_rng(5).standard_normal((20_000, 8))
    rows /= np.sqrt((rows**2).sum(axis=1))[:, None]
    tracemalloc.start()
    centres = cells.fit_centres(rows, 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (2000, 8) and np.allclose((centres**2).sum(axis=1), 1)
    assert peak < 100 << 20  # all rows by all centres are 320 MB


def test_next_cells_are_the_promising_ones():
    from codeloom.operators.vector_index import Cells, expected_hits, first_cells, next_cells

    rng = np.random.default_rng(6)
    rows = []
    for cell in range(3, 63):
        angles = [{"angle": float(a), "n": int(n)} for a, n in zip(rng.uniform(0, 1.5, 4), rng.integers(1, 9, 4), strict=True)]
        rows.append({"cell": cell, "n_rows": sum(a["n"] for a in angles), "angles": angles, "dimension": 16.0})
    cells, apart = Cells.of(rows), rng.uniform(0.2, 2.0, 60)
    read = set(first_cells(cells, apart, 40))
    chosen = next_cells(cells, apart, read, 1.1, 10, 0.9)
    hits = {
        r["cell"]: expected_hits(a, 1.1, [(c["angle"], c["n"]) for c in r["angles"]], 16.0)
        for r, a in zip(rows, apart.tolist(), strict=True)
        if r["cell"] not in read
    }
    size = {r["cell"]: r["n_rows"] for r in rows}
    best = sorted(hits, key=lambda c: (-hits[c] / size[c], c))
    assert chosen and chosen == best[: len(chosen)]
