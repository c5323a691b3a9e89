import numpy as np
import pytest

from graphloom.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, prefix string"


def brute(ids, matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.lexsort((ids, -row))[:k]] for i, row in zip(ids.tolist(), s)}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    scattered = rng.standard_normal((500, 24))
    dense = rng.standard_normal(24) + 0.05 * rng.standard_normal((300, 24))
    clusters = np.repeat(rng.standard_normal((40, 24)), 10, axis=0) + 0.2 * rng.standard_normal((400, 24))
    return np.concatenate([scattered, dense, clusters]).astype(np.float32)


def frame(spark, matrix, more=()):
    return spark.createDataFrame([(i, [float(x) for x in v], 1, None, None) for i, v in enumerate(matrix)] + list(more), SCHEMA)


def test_recall_against_brute_force(spark, data):
    found = {}
    for r in forest.neighbours(frame(spark, data), every=1).collect():
        found.setdefault(r.vec_id, []).append(r)
    true = brute(np.arange(len(data)), data, 10)
    assert set(found) == set(true) and all(len(v) == 10 for v in found.values())
    hits = [len({r.neighbour_id for r in found[i]} & set(true[i])) / 10 for i in true]
    assert np.mean(hits) >= 0.9
    for part in (slice(0, 500), slice(500, 800), slice(800, 1200)):
        assert np.mean(hits[part]) >= 0.9
    assert len({r.prefix for v in found.values() for r in v}) > 2, "searches end at various lengths"
    assert all([r.rank for r in sorted(v, key=lambda r: r.rank)] == list(range(1, 11)) for v in found.values())


def test_the_root_is_exact(spark, data):
    few = data[::8]
    found = {}
    for r in forest.neighbours(frame(spark, few), 5, every=1, miss=0.0).orderBy("rank").collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    true = brute(np.arange(len(few)), few, 5)
    assert np.mean([found[i] == true[i] for i in true]) > 0.99


def test_strings_are_the_signs():
    rng = np.random.default_rng(1)
    v, h = rng.standard_normal((5, 8), dtype=np.float32), forest.planes(8, 3)
    got = forest.strings(v, h)
    for i in range(5):
        for t in range(3):
            assert int("".join("1" if x > 0 else "0" for x in v[i] @ h[:, t * forest.BITS : (t + 1) * forest.BITS]), 2) == got[i, t]


def test_odd_rows_ties_and_repeats(spark):
    rows = [(i, [1.0, float(i % 3)], None, None, None) for i in range(9)]
    odd = [(20, None, None, None, None), (21, [], 1, None, None), (22, [0.0, 0.0], 1, None, None), (23, [1.0, float("nan")], 1, None, None), (24, [1.0, 2.0, 3.0], 1, None, None), (None, [1.0, 0.0], 1, None, None), rows[0], (25, [1.0, None], None, None, None)]
    found = forest.neighbours(spark.createDataFrame(rows + odd, SCHEMA), 2, every=1, miss=0.0).orderBy("vec_id", "rank").collect()
    assert {r.vec_id for r in found} == set(range(9))
    assert [r.neighbour_id for r in found if r.vec_id == 0] == [3, 6] and all(r.similarity > 0.999 for r in found)


def test_few_and_empty(spark):
    assert forest.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert forest.neighbours(spark.createDataFrame([(1, [1.0], None, None, None)], SCHEMA), every=1).count() == 0
    two = forest.neighbours(spark.createDataFrame([(1, [1.0, 0.0], None, None, None), (2, [0.0, 1.0], None, None, None)], SCHEMA), every=1).collect()
    assert sorted((r.vec_id, r.neighbour_id) for r in two) == [(1, 2), (2, 1)]


def test_queries_in_blocks_and_shards(spark, data, monkeypatch):
    """Every fiftieth id is a query; blocks of queries and shards of vectors don't change what is found."""
    whole = {tuple(r) for r in forest.neighbours(frame(spark, data)).collect()}
    assert {r[0] for r in whole} == set(range(0, 1200, 50)) and len(whole) == 240
    monkeypatch.setattr(forest, "BLOCK", 5)
    monkeypatch.setattr(forest, "SHARD", 64)
    again = {tuple(r) for r in forest.neighbours(frame(spark, data)).collect()}
    assert {r[:3] + r[4:] for r in again} == {r[:3] + r[4:] for r in whole}


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    matrix = np.stack(rows["embedding"]).astype(np.float32)
    true = brute(rows["vec_id"].to_numpy(), matrix, 10)
    found = {}
    for r in forest.neighbours(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect():
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert set(found) == {i for i in true if i % 50 == 0}
    assert np.mean([len(found[i] & set(true[i])) / 10 for i in found]) >= 0.9
