"""Whitening against exact integer sums and numpy's eigenvectors of the whole matrix."""

import math

import numpy as np
import pytest

from docrecon.llm.whitening import fit_whitening, op11_whitening, whiten, whitened_rows


def brute(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    z = x * n - s
    y = z / n
    e, w = np.linalg.eigh(y.T @ y / n)
    return n, (z.astype(object) ** 2).sum(axis=1), y, e[::-1], w[:, ::-1]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, WHITENED int")


def compare(out, rows, k):
    ids, vectors = [r[0] for r in rows], [np.float32(r[1]).astype(float) for r in rows]
    n, deviation, y, e, w = brute(vectors)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert set(got) == {(i, c) for i in ids for c in range(1, k + 1)}
    for c in range(1, k + 1):
        want = y @ w[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([got[i, c].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert all(got[i, c].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) for i in ids)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert {(r.n, r.identity_error < 1e-9) for r in got.values()} == {(n, True)}


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 1, 0.5, 0.2]).tolist(), "x", 1) for i in range(300)]
    compare(whitened_rows(frame(spark, rows).repartition(5)), rows, 6)
    compare(whitened_rows(frame(spark, rows), components=2), rows, 2)


def test_nearly_dependent_columns(spark):
    """A column that is the sum of others but for a few units has its own, tiny component."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 3)) * 1e4
    last = a.sum(axis=1) + rng.integers(0, 2, 400) / 64
    rows = [(i, [*map(float, v), float(w)], "x", 1) for i, (v, w) in enumerate(zip(np.float32(a), np.float32(last)))]
    out = whitened_rows(frame(spark, rows))
    assert out.agg({"identity_error": "max"}).first()[0] < 1e-4
    model = fit_whitening(frame(spark, rows))
    _, _, y, _, _ = brute([np.float32(r[1]).astype(float) for r in rows])
    s = np.linalg.svd(y / 20, compute_uv=False)
    assert np.allclose(model.variances, s**2, rtol=1e-6)


def test_odd_rows(spark):
    """Null, ragged, null-holding and non-finite vectors go; constant and repeated columns are no components; repeated rows and
    null keys count; other columns stay."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(50, 2)) * 3
    good = [(i if i else None, [float(np.float32(x)), 7.0, float(np.float32(y)), float(np.float32(x))], "x", 1) for i, (x, y) in enumerate(base)]
    good += [good[3], good[3]]
    bad = [(100, None, "x", 1), (101, [1.0, None, 2.0, 3.0], "x", 1), (102, [1.0, float("nan"), 2.0, 3.0], "x", 1), (103, [1.0, float("inf"), 2.0, 3.0], "x", 1), (104, [1.0], "x", 1), (105, [], "x", 1)]
    df = frame(spark, good + bad)
    model = fit_whitening(df)
    assert model.n == len(good) and len(model.variances) == 2
    out = whiten(df, model)
    assert [c for c in out.columns] == ["vec_id", "embedding", "n", "deviation", "whitened"]
    assert out.count() == len(good) and out.where("vec_id = 3").count() == 3
    w = np.array([r.whitened for r in out.collect()])
    assert np.abs(w.T @ w / len(w) - np.eye(2)).max() < 1e-9
    rows = whitened_rows(df)
    assert rows.count() == 2 * len(good) and rows.where("vec_id is null").count() == 2
    assert whitened_rows(df.where("false")).count() == 0
    assert whitened_rows(df.where("vec_id = 100")).count() == 0
    assert whitened_rows(df.where("vec_id = 3")).count() == 0  # equal vectors have no variance


def test_beyond_64_bits(spark):
    rows = [(0, [3e9, -1e9], "x", 1), (1, [-3e9, 1e12], "x", 1), (2, [1e30, 5.0], "x", 1)]
    df = frame(spark, rows)
    got = {r.vec_id: r.deviation for r in whiten(df, fit_whitening(df)).collect()}
    assert set(got.values()) == {(1 << 63) - 1}
    df = frame(spark, rows[:2])
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows[:2]]
    want = [min((1 << 63) - 1, sum((2 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x)))) for v in x]
    assert [r.deviation for r in whiten(df, fit_whitening(df)).orderBy("vec_id").collect()] == want


def test_query(spark):
    out = op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, deviation, y, e, w = brute([np.float32(v).astype(float) for _, v in rows])
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert len(out) == 32 * n and (out.identity_error < 1e-9).all()
    assert (out.deviation == [deviation[place[i]] for i in out.vec_id]).all()
    for c, part in out.groupby("component"):
        want = y[[place[i] for i in part.vec_id]] @ w[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-6
