"""Whitening against a plain eigen-decomposition, and odd rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import whitening

DATA = "/root/testdata/sf0.001"


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)) + 100_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    n, sums = len(x), x.sum(axis=0)
    return (x - x.mean(axis=0)) @ axes[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum(), ((n * x - sums) ** 2).sum(axis=1).astype(np.int64)


def test_whole_table_against_a_plain_eigen_solve(spark):
    out = whitening.op11_embedding_whitening(spark, DATA).toPandas().sort_values(["vec_id", "component"])
    rows = pq.read_table(f"{DATA}/embeddings.parquet").sort_by("vec_id").to_pydict()
    white, explained, deviations = plain(rows["embedding"])
    n = len(white)
    assert out.vec_id.tolist() == np.repeat(rows["vec_id"], 8).tolist() and out.component.tolist() == list(range(1, 9)) * n
    got = out.whitened.to_numpy().reshape(n, 8)
    assert np.abs(got * np.sign((got * white[:, :8]).sum(axis=0)) - white[:, :8]).max() < 1e-9
    assert np.allclose(out.explained.to_numpy()[:8], explained[:8], rtol=1e-9)
    assert out.deviation.tolist() == np.repeat(deviations, 8).tolist()
    assert set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_qr_solves_what_a_library_solves(n):
    rng = np.random.default_rng(n)
    for v in (rng.normal(size=(n, n)), np.zeros((n, n)), np.eye(n) * 3, np.outer(np.arange(n), np.arange(n)), np.diag(rng.integers(0, 3, n)).astype(float)):
        v = v @ v.T
        values, vectors = whitening.symmetric_qr(v.astype(float))
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * max(1, np.abs(v).max()) * n)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12) and np.allclose(vectors.T * values @ vectors, v, atol=1e-11 * max(1, np.abs(v).max()) * n)


def test_merged_states_equal_one_state(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    one = whitening.fit(df.coalesce(1), "embedding", 8)[0]
    many = whitening.fit(df.repartition(13), "embedding", 8)[0]
    assert one["sums"] == many["sums"] and np.allclose(one["values"], many["values"], rtol=1e-12)
    assert np.allclose(np.frombuffer(one["vectors"]), np.frombuffer(many["vectors"]), atol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 4.0]), (1, [1.0, 2.0, 4.0]), (None, [0.5, -2.0, 1.0]), (2, [3.0, 0.0, 1.0]), (20, [-1.0, 6.0, 0.25]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 0.0]), (8, [7.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0]), (11, [1e300, 0.0, 0.0, 0.0]), (12, [-1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS n", "'x' AS whitened", "8 AS _vector", "9 AS _told", "10 AS _key")
    for size in (whitening.MODEL_BYTES, 1):  # of one block of models, and of one for each length
        with pytest.MonkeyPatch.context() as m:
            m.setattr(whitening, "MODEL_BYTES", size)
            out = whitening.whiten(df).collect()
        by = {}
        for r in out:
            by.setdefault(r.vec_id, []).append(r)
        assert sorted(by, key=str) == [1, 10, 11, 12, 2, 20, 8, 9, None] and len(by[1]) == 2
        assert by[1][0].n == 5 and by[8][0].n == 1 and by[8][0].whitened == [None] and by[8][0].explained == [None] and by[8][0].deviation == 0
        assert by[9][0].whitened == [None, None] and by[9][0].identity_error is None
        white, explained, deviations = plain([v for _, v in rows[:5]])
        order = [by[1][0], by[1][1], by[None][0], by[2][0], by[20][0]]
        got = np.array([r.whitened for r in order])
        assert np.allclose(np.abs(got), np.abs(white), atol=1e-9) and [r.deviation for r in order] == deviations.tolist()
        assert by[1][0].identity_error < 1e-9 and math.isclose(sum(by[1][0].explained), 1)
        assert (by[1][0]._vector, by[1][0]._told, by[1][0]._key) == (8, 9, 10)
        assert by[11][0].deviation is None and by[11][0].whitened[0] == -by[12][0].whitened[0] and by[11][0].whitened[1] is None
    assert whitening.whiten(df.where("false")).collect() == []
