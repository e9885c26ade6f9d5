from __future__ import annotations

import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pplscope.operators import regression as R

MODELS = [f"m{i}" for i in range(6)]
ALPHAS = np.logspace(-4, 2, 50)


def plain_lasso(x, y, alpha, rounds=4000):
    """Cyclic coordinate descent over every feature."""
    n, p = x.shape
    x, y = x - x.mean(0), y - y.mean()
    w, r, size = np.zeros(p), y.copy(), (x * x).sum(0) / n
    for _ in range(rounds):
        moved = 0.0
        for j in range(p):
            if size[j] > 0:
                old, rho = w[j], x[:, j] @ r / n + size[j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / size[j]
                if w[j] != old:
                    r -= x[:, j] * (w[j] - old)
                    moved = max(moved, abs(w[j] - old))
        if moved < 1e-13:
            break
    return w


def plain_loo(x, y, alphas):
    """Leave-one-out with an inner leave-one-out choice of alpha, all features at once."""
    def choose_and_fit(rows):
        z = x[rows] / np.where(x[rows].std(0) == 0, 1, x[rows].std(0))
        errors = np.zeros(len(alphas))
        for hold in range(len(rows)):
            rest = [i for i in range(len(rows)) if i != hold]
            for a, alpha in enumerate(alphas):
                w = plain_lasso(z[rest], y[rows][rest], alpha)
                errors[a] += (y[rows][hold] - (y[rows][rest] - z[rest] @ w).mean() - z[hold] @ w) ** 2
        best = alphas[int(np.argmin(errors))]
        return best, plain_lasso(z, y[rows], best), z

    n, out = len(y), []
    for test in range(n):
        rows = np.array([i for i in range(n) if i != test])
        _, w, z = choose_and_fit(rows)
        scale = np.where(x[rows].std(0) == 0, 1, x[rows].std(0))
        out.append((y[rows] - z @ w).mean() + x[test] / scale @ w)
    alpha, w, _ = choose_and_fit(np.arange(n))
    return np.array(out), alpha, w


@pytest.mark.parametrize("seed", range(4))
def test_path_agrees_with_coordinate_descent(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.lognormal(size=(5, 12)), rng.uniform(0.3, 0.7, 5)
    x[:, 3] = x[:, 4]
    x /= x.std(0)
    c, t = x - x.mean(0), y - y.mean()

    def loss(w, alpha):
        return ((t - c @ w) ** 2).mean() / 2 + alpha * np.abs(w).sum()

    grid = np.sort(ALPHAS)[::-1]
    for alpha, w in zip(grid, R.path_coefficients(x, y, grid)):
        reference = plain_lasso(x, y, alpha)
        assert loss(w, alpha) <= loss(reference, alpha) + 1e-14
        # At smaller alphas cyclic descent takes too long to settle to be compared closely.
        if alpha > 0.05:
            assert c @ w == pytest.approx(c @ reference, abs=1e-6)


def test_path_is_optimal_with_many_features():
    rng = np.random.default_rng(7)
    grid = np.sort(ALPHAS)[::-1]
    for n, p in ((3, 50), (5, 400), (6, 1), (5, 0)):
        x, y = rng.lognormal(size=(n, p)), rng.uniform(size=n)
        c, t = x - x.mean(0), y - y.mean()
        for alpha, w in zip(grid, R.path_coefficients(x, y, grid)):
            slope = c.T @ (t - c @ w) / n
            assert np.all(np.abs(slope) <= alpha * (1 + 1e-7))
            assert np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), rtol=1e-7)


def features_of(spark, x):
    rows = [(j % 3, j, x[:, j].tolist()) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "text_id long, chunk_id long, values array<double>").repartition(4)


def test_active_set_equals_fitting_all_features(spark):
    rng = np.random.default_rng(1)
    x, y = 1 + rng.lognormal(size=(6, 15)), rng.uniform(0.4, 0.9, 6)
    x[:, 5] = 2.0
    alphas = np.logspace(-2, 0, 8)
    labels = dict(zip(MODELS, map(float, y)))
    predictions, alpha, w = plain_loo(x, y, np.sort(alphas)[::-1])
    features = features_of(spark, x)
    for start in (None, features.orderBy("chunk_id").limit(3)):
        fit = R.lasso_loo(features, labels, alphas, start)
        got = {r.model: r.prediction for r in fit.predictions.collect()}
        assert [got[m] for m in MODELS] == pytest.approx(predictions, abs=1e-6)
        assert fit.alpha == pytest.approx(alpha)
        found = {r.chunk_id: r.beta for r in fit.coefficients.collect()}
        assert found == pytest.approx({j: b for j, b in enumerate(w) if b != 0}, abs=1e-6)
        assert {r.alpha for r in R.nonzero_coefficients(fit).collect()} <= {fit.alpha}


@pytest.mark.parametrize("n_fits", [6, 600])
def test_features_looked_through_are_let_go(monkeypatch, n_fits):
    monkeypatch.setattr(R, "CELLS", 3000)
    rng = np.random.default_rng(3)
    residuals, bound = rng.normal(size=(6, n_fits)), np.full(n_fits, 0.5)
    trains, fold_of = [np.arange(5), np.arange(1, 6)], np.arange(n_fits) % 2
    made, alive = [], []

    def batches():
        for b in range(30):
            alive.append(sum(ref() is not None for ref in made))
            # Rows of a list column are views of one array, and later features break optimality more.
            x = (1 + b) * rng.lognormal(size=(40, 6)) * np.array([1.0, 1.0, 1.0, 1.0, 1.0, 1.0 + b])
            made.append(weakref.ref(x))
            seen.append(x.copy())
            yield pd.DataFrame({"text_id": b, "chunk_id": range(40), "values": list(x)})
            del x

    seen: list[np.ndarray] = []
    got = R._worst_features(batches(), residuals, bound, trains, fold_of)
    assert max(alive) <= 2 and all(v.base is None for v in got["values"])
    x = np.concatenate(seen)
    scale = np.stack([R._scales(x[:, t].T) for t in trains], axis=1)
    ratio = np.abs(x @ residuals) / (scale[:, fold_of] * bound)
    want = {f: divmod(int(i), 40) for f, i in enumerate(ratio.argmax(0)) if ratio[i, f] > 1 + R.VIOLATION}
    assert {r.fit: (r.text_id, r.chunk_id) for r in got.itertuples()} == want and want
    assert all(np.array_equal(v, seen[t][c]) for t, c, v in zip(got["text_id"], got["chunk_id"], got["values"]))


def test_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, label double, prediction double")
    row = R.loo_metrics(df).first()
    assert row.mse == pytest.approx(((y - p) ** 2).mean())
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_folds_and_scaling(spark):
    folds = R.loo_folds(spark.createDataFrame([(m,) for m in MODELS], "model string")).collect()
    assert len(folds) == 36 and all(r.is_test == (r.model == MODELS[r.fold]) for r in folds)
    x = np.column_stack([np.arange(1.0, 7.0), np.full(6, 0.1)])
    for r in R.scale_features(features_of(spark, x), MODELS).collect():
        i = MODELS.index(r.model)
        std = np.delete(x[:, r.chunk_id], r.fold).std() if r.chunk_id == 0 else 1.0
        assert r.scaled == pytest.approx(x[i, r.chunk_id] / std)
        assert r.is_test == (i == r.fold)


def test_features_need_every_model(spark):
    ppl = spark.createDataFrame(
        [(0, 0, "m0", 1.0), (0, 0, "m1", 2.0), (0, 1, "m0", 3.0), (0, 2, "m0", 4.0), (0, 2, "m1", None)],
        "text_id long, chunk_id long, model string, ppl double",
    )
    assert [r["values"] for r in R.feature_rows(ppl, ["m0", "m1"]).collect()] == [[1.0, 2.0]]
    acc = spark.createDataFrame([("m0", 0.5), ("m1", None)], "model string, accuracy double")
    assert R.design_matrix(ppl, acc).where(F.col("label") == 0.5).count() == 3
