import numpy as np
import pytest

from codewhiff.llm import hnsw as H
from codewhiff.llm import queries
from helpers import CLASHING


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    for c in CLASHING if clash else ():
        df = df.selectExpr("*", f"1 as `{c}`")
    return df


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("shard_size", [120, 5000])
def test_recall(spark, shard_size):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(400, 24)), r.normal(size=(12, 24)).repeat(50, axis=0) + 0.1 * r.normal(size=(600, 24))]).astype(np.float32)
    out = H.nearest_neighbours(vectors(spark, list(enumerate(x.tolist()))), k=10, shard_size=shard_size).collect()
    got = {}
    for row in out:
        got.setdefault(row.vec_id, {})[row["rank"]] = row.neighbor_id
        assert row.distance == pytest.approx(float(np.linalg.norm(x[row.vec_id].astype(float) - x[row.neighbor_id])), abs=1e-6)
    want = brute(x.astype(float), 10)
    assert all(sorted(v) == list(range(1, 11)) for v in got.values()) and len(got) == len(x)
    recall = np.mean([len(set(got[i].values()) & set(want[i].tolist())) / 10 for i in range(len(x))])
    assert recall >= 0.9, recall


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids = [i for i, _ in rows]
    want = brute(np.array([v for _, v in rows], dtype=float), 10)
    got = {}
    for r in H.nearest_neighbours(df, k=10, shard_size=200).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    assert np.mean([len(got[i] & {ids[j] for j in want[n]}) / 10 for n, i in enumerate(ids)]) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [0, 0]), (2, [0, 1]), (2, [0, 1]), (3, None), (None, [1, 1]), (4, []), (5, [1, None]), (6, [float("nan"), 0]), (7, [1, 2, 3]), (8, [0, 3]), (9, [float("inf"), 1]), (10, [0, 1])]
    out = sorted((r.vec_id, r["rank"], r.neighbor_id, round(r.distance, 6)) for r in H.nearest_neighbours(vectors(spark, rows, clash=True), k=2).collect())
    assert out == [(1, 1, 2, 1.0), (1, 2, 10, 1.0), (2, 1, 10, 0.0), (2, 2, 1, 1.0), (8, 1, 2, 2.0), (8, 2, 10, 2.0), (10, 1, 2, 0.0), (10, 2, 1, 1.0)]
    assert H.nearest_neighbours(vectors(spark, [])).collect() == []
    assert H.nearest_neighbours(vectors(spark, [(1, [1, 2])])).collect() == []


def test_all_equal(spark):
    out = H.nearest_neighbours(vectors(spark, [(i, [1, 1, 1]) for i in range(60)]), k=3, shard_size=20).collect()
    assert len(out) == 180 and {r.distance for r in out} == {0.0} and all(r.vec_id != r.neighbor_id for r in out)


def test_round_trip():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8)).astype(np.float32)
    g = H.Graph.built(x)
    h, ids = H.Graph.from_bytes(g.to_bytes(np.arange(200)))
    a, b = g.search(x[:20], 5, 40), h.search(x[:20], 5, 40)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and ids.tolist() == list(range(200))


def test_queries_against_all_rows(spark):
    """The registered query: every hundredth vector, all of whose neighbours are searched."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids = np.array([i for i, _ in rows])
    want = brute(np.array([v for _, v in rows], dtype=float), 10)
    got = {}
    for r in queries.op7_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    asked = [n for n, i in enumerate(ids.tolist()) if i % 100 == 0]
    assert set(got) == {int(ids[n]) for n in asked}
    assert np.mean([len(got[int(ids[n])] & set(ids[want[n]].tolist())) / 10 for n in asked]) >= 0.9


def test_queries_of_their_own(spark):
    rows = [(1, [0, 0]), (2, [0, 1]), (3, [5, 5])]
    asked = [(1, [5, 4]), (9, [0, 0.9]), (None, [0, 0]), (8, None), (7, [1, 2, 3])]
    out = sorted((r.vec_id, r["rank"], r.neighbor_id) for r in H.nearest_neighbours(vectors(spark, rows), vectors(spark, asked, clash=True), k=2).collect())
    assert out == [(1, 1, 3), (1, 2, 2), (9, 1, 2), (9, 2, 1)]
    assert H.nearest_neighbours(vectors(spark, []), vectors(spark, asked), k=2).collect() == []
    assert H.nearest_neighbours(vectors(spark, rows), vectors(spark, []), k=2).collect() == []
