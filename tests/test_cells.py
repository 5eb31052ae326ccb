"""The cell index against the search that compares everything."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from groundsieve.functions.cells import cell_bounds, nearest_cells
from groundsieve.operators.cells import build_cells, cell_search, probes_for, read_cells, write_cells
from groundsieve.operators.dense import dense_search

rng = random.Random(3)
DIMS = 6
NAN = float("nan")


def around(centre, spread):
    return [c + rng.gauss(0, spread) for c in centre]


CENTRES = [[rng.gauss(0, 1) for _ in range(DIMS)] for _ in range(12)]
VECTORS = [(f"p{i:04d}", around(rng.choice(CENTRES), 0.15)) for i in range(900)]
VECTORS += [(f"c{i:03d}", VECTORS[0][1]) for i in range(300)]  # copies
VECTORS += [("zero1", [0.0] * DIMS), ("zero2", [0.0] * DIMS), ("nan", [NAN] * DIMS), ("none", None),
            ("inf", [math.inf] + [1.0] * (DIMS - 1)), ("gap", [None] + [1.0] * (DIMS - 1))]
QUERIES = [(f"q{i}", around(rng.choice(CENTRES), 0.3)) for i in range(25)] + [
    ("copy", VECTORS[0][1]), ("far", [-x for x in CENTRES[0]]), ("zero", [0.0] * DIMS), ("bad", [NAN] * DIMS)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "passage_id string, vector array<double>").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, vector array<double>")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    write_cells(build_cells(vectors, DIMS, cells=20, sample=400, part=100), path)
    return read_cells(spark, path)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "passage_id", "dense_score", "rank_dense").collect())


@pytest.mark.parametrize("k, probes, at_once", [(10, 4, 1024), (1, 1, 3), (2000, 2, 5)])
def test_exact_mode(vectors, index, queries, k, probes, at_once):
    got = cell_search(index, queries, k, probes, queries_at_once=at_once)
    assert rows(got.hits) == rows(dense_search(vectors, queries.where("query_id <> 'bad'"), k, DIMS, hashed=False))


def test_cells_are_skipped(index, queries):
    report = {r["query_id"]: r for r in cell_search(index, queries, 5, probes=2).report.collect()}
    assert all(r["n_cells"] == 21 and 2 <= r["n_cells_read"] <= 21 for r in report.values())
    assert sum(r["n_cells_read"] < 12 for r in report.values()) > 15
    assert report["zero"]["n_cells_read"] == 21  # all scores are 0


def test_every_vector_is_stored_once(index):
    held = [(r["passage_id"], r["cell"], r["part"]) for r in index.vectors.collect()]
    sound = {p for p, v in VECTORS if v and all(x is not None and math.isfinite(x) for x in v)}
    assert sorted(p for p, _, _ in held) == sorted(sound)
    sizes = {}
    for _, cell, part in held:
        sizes[cell, part] = sizes.get((cell, part), 0) + 1
    assert max(sizes.values()) < 200  # of about 100


def test_only_files_of_wanted_cells_are_read(index):
    some = index.vectors.where("cell IN (1, 2)")
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_hold(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(3, 4))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    points, queries = r.normal(size=(30, 4)), r.normal(size=(5, 4))
    cell, angle = nearest_cells(points, centres)
    for c in range(3):
        if (cell == c).any():
            near, far = angle[cell == c].min(), angle[cell == c].max()
            bound = cell_bounds(queries, centres[c: c + 1], np.array([near]), np.array([far]))[1][:, 0]
            cosines = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (
                points / np.linalg.norm(points, axis=1)[:, None]).T
            assert (cosines[:, cell == c].max(axis=1) <= bound + 1e-9).all()


def test_recall_of_the_fast_mode_on_the_given_vectors(spark):
    from pyspark.sql import functions as F

    held = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("passage_id"), F.col("embedding").alias("vector"))
    asked = held.where(F.col("passage_id").cast("int") % 20 == 0).select(F.col("passage_id").alias("query_id"), "vector")
    index = build_cells(held, 64)
    probes = probes_for(index, 10, 0.97)
    fast = {r[:2] for r in rows(cell_search(index, asked, 10, probes, exact=False).hits)}
    want = {r[:2] for r in rows(dense_search(held, asked, 10, 64, hashed=False))}
    assert len(fast & want) >= 0.95 * len(want)


def test_empty_tables(spark, vectors, queries):
    none = spark.createDataFrame([], "passage_id string, vector array<double>")
    assert cell_search(build_cells(none, DIMS), queries, 3).hits.count() == 0
    index = build_cells(vectors, DIMS, cells=4)
    assert cell_search(index, queries.limit(0), 3).hits.count() == 0
    with pytest.raises(Exception, match="has 2 numbers"):
        build_cells(spark.createDataFrame([("x", [1.0, 2.0])], "passage_id string, vector array<double>"), DIMS)
