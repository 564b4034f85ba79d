"""Neighbours against a comparison of all vectors: recall on the given tables, exact rows on small ones."""

import numpy as np
import pytest

from foliolens.llm import posting_lists
from foliolens.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k=20):
    """``{query: [(vec_id, score)]}`` by summing in order, ties to the smaller id."""
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in kept), default=0)
    ids = np.array([i for i, _ in kept])
    points = np.array([[*v, *[0.0] * (width - len(v))] for _, v in kept]).reshape(len(kept), width)
    found = {}
    for query, own in zip(ids, points):
        if query % every == 0:
            scores = np.cumsum(points * own, axis=1)[:, -1]
            order = np.lexsort((ids, -scores))
            found[int(query)] = [(int(ids[i]), float(scores[i])) for i in order if ids[i] != query][:k]
    return found


def grouped(frame):
    found = {}
    for row in sorted(frame.collect(), key=lambda row: (row.query_id, row.rank)):
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    return found


def recall(found, wanted):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in near}) / max(1, len(near)) for q, near in wanted.items()])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    frame = QUERIES["op13_nearest"](spark, path)
    assert frame.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found, wanted = grouped(frame), brute(rows, 20)
    assert found.keys() == wanted.keys() and all(len(near) == 20 for near in found.values())
    assert recall(found, wanted) >= 0.9
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    for query, near in found.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0])) and len({i for i, _ in near}) == 20
        assert all(score == np.cumsum(vectors[query] * vectors[i])[-1] for i, score in near)


def test_lengths_that_differ_and_copies(spark, monkeypatch):
    """Long vectors win by inner product, a third of all rows are equal, and blocks are small."""
    random = np.random.default_rng(3)
    points = random.normal(size=(400, 8)) * random.gamma(2.0, 1.0, (400, 1))
    rows = [(i, [float(x) for x in np.float32(p)]) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    monkeypatch.setattr(posting_lists, "BLOCK_ROWS", 16)
    frame = spark.createDataFrame([(*row, 0) for row in rows], SCHEMA)
    found, wanted = grouped(posting_lists.nearest(frame, 10)), brute(rows, 10)
    assert found.keys() == wanted.keys() and recall(found, wanted) >= 0.9
    assert found[1000] == wanted[1000] and found[1190] == wanted[1190]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [1.0, inf]), (8, [1.0, None]), (None, [9.0, 9.0]), (9, [-1.0, 0.0]), (20, [2.0]), (40, [1.0, 0.0, 3.0]), (60, [0.0, -0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*row, None, "x", 1, "y") for row in rows], SCHEMA + ", vec string, key int, list string")
    assert grouped(posting_lists.nearest(frame, 20)) == brute(rows, 20)


def test_no_rows(spark):
    assert posting_lists.nearest(spark.createDataFrame([], SCHEMA), 20).collect() == []
    assert posting_lists.nearest(spark.createDataFrame([(0, None, 1)], SCHEMA), 20).collect() == []
    assert posting_lists.nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA), 20).collect() == []


def test_walks_find_the_nearest_centroids():
    random = np.random.default_rng(5)
    sample = random.normal(size=(6000, 16))
    held = posting_lists.Centroids.fitted(sample, 400, float((sample**2).sum(1).max()))
    queries = np.hstack([random.normal(size=(300, 16)), np.zeros((300, 1))])
    numbers, away = held.search(queries, 32)
    exact = np.argsort(posting_lists.distances(queries, held.points), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(numbers[:, :10].tolist(), exact.tolist())]) > 0.97
    assert (np.diff(away, axis=1) >= 0).all()


def test_clusters_are_balanced():
    sample = np.concatenate([np.zeros((500, 3)), np.random.default_rng(1).normal(size=(1500, 3))])
    points = posting_lists.balanced_centroids(sample, 20)
    assert 16 <= len(points) <= 40
